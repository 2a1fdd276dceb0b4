"""Small frames with known results."""

import numpy as np
import pandas as pd


def readings():
    """Even values without gaps, repeats or outliers."""
    rng = np.random.RandomState(711)
    return pd.DataFrame(
        {
            "site": np.arange(1, 131) * 3,
            "depth": rng.permutation(130) / 2.0,
            "flow": rng.randint(200, 900, 130),
            "height": rng.uniform(-1, 1, 130).round(4),
        }
    )


def half_empty():
    rng = np.random.RandomState(12)
    return pd.DataFrame({"depth": np.where(np.arange(90) % 9 < 5, np.nan, rng.randint(0, 8, 90).astype(float))})


def repeats():
    return pd.DataFrame({"code": [7, 8, 9, 10] * 18, "tag": ["north", "south", "east", "west"] * 18})


def spiked():
    rng = np.random.RandomState(311)
    return pd.DataFrame({"level": [*rng.normal(20, 4, 140), -31, 77.5, 90, 123]})


def score_only_outlier():
    return pd.DataFrame({"value": [-1.0] * 500 + [1.0] * 500 + [3.5]})


def random_frame(seed, n=400):
    """Mixed columns with missing values, repeats, a constant and awkward names."""
    rng = np.random.RandomState(seed)
    frame = pd.DataFrame(
        {
            "whole": rng.randint(-50, 50, n).astype(float),
            "skewed": rng.lognormal(0, 2, n),
            "Life (years)": rng.normal(70, 5, n),
            "with.dot": rng.randint(0, 4, n).astype(float),
            "constant": 0.1,
            "group": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]),
        }
    )
    for column, share in (("whole", 0.2), ("skewed", 0.05), ("with.dot", 0.5)):
        frame.loc[rng.rand(n) < share, column] = np.nan
    return frame


def two_points(n, mean, sd):
    """``n`` values, ``n`` even, of exactly this mean and sample deviation."""
    step = sd * ((n - 1) / n) ** 0.5
    return [mean - step] * (n // 2) + [mean + step] * (n // 2)


def patients_file(folder, n=700):
    """A CSV file with a byte order mark, names with spaces, exponents, empty cells, and an
    outcome whose digit 0 was typed as the letter O six times."""
    rng = np.random.RandomState(5)
    outcome = rng.choice(["0", "1"], n, p=[0.65, 0.35])
    frame = pd.DataFrame(
        {
            "Visits": rng.poisson(3, n),
            "Glucose": rng.normal(120, 30, n).round(0),
            "Insulin (mU)": rng.lognormal(4, 1, n).round(1),
            "Income": rng.lognormal(24, 1, n),
            "Outcome": outcome,
            "City": rng.choice(["Lima", "Quito", "La Paz"], n),
        }
    )
    frame.loc[np.where(outcome == "0")[0][:6], "Outcome"] = "O"
    frame.loc[rng.rand(n) < 0.1, "Glucose"] = np.nan
    path = folder / "patients.csv"
    frame.to_csv(path, index=False, encoding="utf-8-sig", float_format="%.6G")
    return str(path)
