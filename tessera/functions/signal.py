"""Facts of sampled signals held as arrays, as expressions; spectra as Arrow-batched functions."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.udf import mapped

# Gate levels.
QUIET, ACTIVE_LEAST, RMS_LEAST, TAIL_PEAK_MOST, SIBILANT_LEAST = 0.01, 0.01, 1e-4, 0.02, 0.03
RATE, TAIL_SECONDS = 24000, 0.08
#: Words whose final ch is not a sibilant.
HARD_CH = {"monarch", "patriarch", "matriarch", "oligarch", "hierarch", "epoch", "stomach", "eunuch"}


def _sum(x: Column, f) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + f(v))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))), F.lit(0.0))


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(_sum(x, lambda v: v.cast("double") * v.cast("double")) / F.size(x))).otherwise(0.0)


def active_ratio(x: Column, quiet: float = QUIET) -> Column:
    return F.when(F.size(x) > 0, F.size(F.filter(x, lambda v: F.abs(v) > quiet)) / F.size(x)).otherwise(0.0)


def tail_peak(x: Column, samples: int) -> Column:
    return F.when(F.size(x) > 0, peak(F.slice(x, -F.least(F.lit(samples), F.size(x)), samples))).otherwise(0.0)


def trailing_quiet(x: Column, quiet: float = QUIET) -> Column:
    """Samples after the last loud one; all of them if none is loud."""
    loud = F.filter(F.transform(x, lambda v, i: F.when(F.abs(v) > quiet, i)), lambda i: i.isNotNull())
    return F.size(x) - F.coalesce(F.array_max(loud) + 1, F.lit(0))


def leading_quiet(x: Column, quiet: float = QUIET) -> Column:
    return trailing_quiet(F.reverse(x), quiet)


def gates(facts: dict[str, Column], rate: int = RATE) -> Column:
    """Names of the structural gates that a signal fails, in a fixed order."""
    bad = {
        "sample_rate": facts["sample_rate"] != rate, "channels": facts["channels"] != 1, "subtype": facts["subtype"] != "PCM_16", "empty": facts["samples"] == 0,
        "stale": ~facts["fresh"], "non_finite": ~facts["finite"], "rms": ~(facts["rms"] > RMS_LEAST), "active_ratio": ~(facts["active_ratio"] > ACTIVE_LEAST),
        "peak": ~(facts["peak"] < 1.0), "full_scale": facts["full_scale"] > 0,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in bad.items()]))


def _bands(x: np.ndarray, rate: int, low: float, high: float) -> list[float]:
    """Energy share between two frequencies in each 25 ms window that isn't near silence."""
    w = int(0.025 * rate)
    n = len(x) // w if w else 0
    if not n:
        return []
    win = x[: n * w].reshape(n, w) * np.hanning(w)
    win = win[np.sqrt((win**2).mean(axis=1)) >= 0.002]
    energy = np.abs(np.fft.rfft(win, axis=1)) ** 2
    freq = np.fft.rfftfreq(w, 1 / rate)
    return (energy[:, (freq >= low) & (freq <= high)].sum(axis=1) / (energy.sum(axis=1) + 1e-12)).tolist()


def speech_share(x, rate: int = RATE) -> float:
    x = np.asarray(x if x is not None else [], dtype=float)
    loud = np.flatnonzero(np.abs(x) > QUIET)
    shares = _bands(x[loud[0] : loud[-1] + 1], rate, 2000, 8000) if len(loud) else []
    return float(np.mean(shares)) if shares else 0.0


def sibilant_share(x, text: str, rate: int = RATE) -> float | None:
    """Largest 4-10 kHz share in the last 350 ms of speech; None unless the text ends in a sibilant."""
    words = re.findall(r"[\w']+", text or "")
    last = words[-1].lower() if words else ""
    if last in HARD_CH or not re.search(r"(?:s|x|z|ch|sh|ce|se|ze|ge)(?:'s)?$", last):
        return None
    x = np.asarray(x if x is not None else [], dtype=float)
    loud = np.flatnonzero(np.abs(x) > QUIET)
    end = loud[-1] + 1 if len(loud) else len(x)
    return max(_bands(x[max(0, end - int(0.35 * rate)) : end], rate, 4000, 10000), default=0.0)


def resampled(x, rate: int) -> list[float]:
    """16 kHz from 24, 32 or 48 kHz by a windowed sinc at the common multiple."""
    x = np.asarray(x, dtype=float)
    up, down = {16000: (1, 1), 24000: (2, 3), 32000: (1, 2), 48000: (1, 3)}[rate]
    if up == down:
        return x.tolist()
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    n = np.arange(-64, 65)
    taps = np.sinc(2 * min(8000, rate / 2) / (rate * up) * n) * np.hanning(len(n))
    return (np.convolve(spread, taps / taps.sum(), mode="same") * up)[::down][: round(len(x) * up / down)].tolist()


@mapped("double")
def speech_share_of(x):
    return speech_share(x)


@mapped("double")
def sibilant_share_of(x, text):
    return sibilant_share(x, text)
