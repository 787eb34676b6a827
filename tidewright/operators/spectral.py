"""Spectra of many signals, and what follows from them.

A signal is a series; fs is its sample rate. spectrum() makes the long table series_id, n, bin,
freq, mag, psd by one transform for each series; everything else is built on that table. Numbers
that are not finite are dropped before. Peaks are local maxima, strongest first; the fundamental is
the strongest of them that is not at zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .findings import check, ladder, phase, skipped
from .stats import KEY, kurtosis, ratio

TINY = 1e-30
#: Cosine coefficients of the windows, first with plus, then alternating signs; symmetric.
WINDOWS = {"boxcar": (1.0,), "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168), "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)}
_SCHEMA = "series_id string, n long, bin long, freq double, mag double, psd double"


def window_values(name: str, n: int) -> np.ndarray:
    if n <= 1:
        return np.ones(n)
    angle = 2 * np.pi * np.arange(n) / (n - 1)
    return sum((-1) ** k * c * np.cos(k * angle) for k, c in enumerate(WINDOWS[name]))


def next_pow2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def transform(x: np.ndarray, fs: float, window: str = "hann") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, single-sided amplitudes and power density of a zero-padded windowed signal."""
    w = window_values(window, len(x))
    gain, nfft = (float(w.mean()) or 1.0), next_pow2(len(x))
    size = np.abs(np.fft.rfft(x * w, nfft))
    mag = size * 2 / (len(x) * gain)
    mag[0] /= 2
    if len(mag) > 1:
        mag[-1] /= 2
    psd = size**2 / (fs * len(x) * gain**2)
    psd[1:-1] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), mag, psd


def spectrum(signals: DataFrame, fs: float = 1.0, window: str = "hann") -> DataFrame:
    """series_id, n, bin, freq, mag, psd of each signal, whose values must fit into one task."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = table["value"].to_numpy()
        freq, mag, psd = transform(x, fs, window)
        k = len(freq)
        return pa.table({"series_id": pa.array([table[KEY][0].as_py()] * k, pa.string()), "n": np.full(k, len(x)), "bin": np.arange(k), "freq": freq, "mag": mag, "psd": psd})

    rows = signals.select(F.col(KEY).cast("string"), F.col("t").cast("long"), F.col("value").cast("double")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return rows.groupBy(KEY).applyInArrow(one, _SCHEMA)


def peaks(spec: DataFrame, top: int = 10) -> DataFrame:
    """series_id, rank, freq, mag of the top local maxima, strongest first."""
    w = Window.partitionBy(KEY).orderBy("bin")
    rows = spec.withColumn("a", F.lag("mag").over(w)).withColumn("b", F.lead("mag").over(w)).where("mag > a and mag > b")
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("mag"), "bin"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select(KEY, "rank", "bin", "freq", "mag")


def centroid(freq: Column | str = "freq", mag: Column | str = "mag") -> Column:
    freq, mag = (F.col(c) if isinstance(c, str) else c for c in (freq, mag))
    return F.coalesce(ratio(F.sum(freq * mag), F.sum(mag)), F.lit(0.0))


def flatness(psd: str = "psd") -> Column:
    p = F.when(F.col(psd) > 0, F.col(psd))
    return F.coalesce(ratio(F.exp(F.avg(F.log(p))), F.avg(p)), F.lit(0.0))


def rolloff(spec: DataFrame, *shares: float) -> DataFrame:
    """series_id and for each share the first frequency up to which it of the squared amplitudes lies."""
    w = Window.partitionBy(KEY)
    e = F.col("mag") * F.col("mag")
    rows = spec.withColumn("upto", F.sum(e).over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum(e).over(w))
    # A hair below, so that the order of summation does not move the bin.
    return rows.groupBy(KEY).agg(*[F.coalesce(F.min(F.when(F.col("upto") >= s * F.col("all") * (1 - 1e-12), F.col("freq"))), F.lit(0.0)).alias(f"rolloff_{round(100 * s)}") for s in shares])


def shape(spec: DataFrame) -> DataFrame:
    """series_id, centroid, spread, flatness, rolloffs, peak_freq, peak_mag of each spectrum."""
    above = F.col("bin") > 0
    c = spec.groupBy(KEY).agg(centroid().alias("centroid"), flatness().alias("flatness"), F.max(F.when(above, F.struct("mag", (-F.col("bin")).alias("b"), "freq"))).alias("p"))
    s = spec.join(c.select(KEY, "centroid"), KEY).groupBy(KEY).agg(F.sqrt(F.coalesce(ratio(F.sum((F.col("freq") - F.col("centroid")) ** 2 * F.col("mag")), F.sum("mag")), F.lit(0.0))).alias("spread"))
    return c.join(s, KEY).join(rolloff(spec, 0.85, 0.95, 0.99), KEY).select(KEY, "centroid", "spread", "flatness", "rolloff_85", "rolloff_95", "rolloff_99", F.col("p.freq").alias("peak_freq"), F.col("p.mag").alias("peak_mag"))


def compare_spectra(signals: DataFrame, fs: float = 1.0) -> DataFrame:
    rms = signals.groupBy(F.col(KEY).cast("string").alias(KEY)).agg(F.sqrt(F.avg(F.col("value") ** 2)).alias("rms"))
    return rms.join(shape(spectrum(signals, fs)).select(KEY, "centroid", "rolloff_95", "flatness", "peak_freq", "peak_mag"), KEY)


def band_energy(spec: DataFrame, fs: float = 1.0, bands: int = 8) -> DataFrame:
    """series_id, band, energy, pct of equal bands up to half the sample rate; a bin on an edge counts on both sides."""
    width = fs / 2 / bands
    inside = F.filter(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: (F.col("freq") >= b * width) & (F.col("freq") <= (b + 1) * width))
    # All bins are as wide as the first.
    step = F.max(F.when(F.col("bin") == 1, F.col("freq"))).over(Window.partitionBy(KEY))
    rows = spec.withColumn("e", F.col("psd") * F.coalesce(step, F.lit(1.0)))
    total = rows.groupBy(KEY).agg(F.sum("e").alias("total"))
    own = rows.withColumn("band", F.explode(inside)).groupBy(KEY, "band").agg(F.sum("e").alias("energy")).join(total, KEY)
    return own.select(KEY, "band", "energy", F.coalesce(100 * ratio(F.col("energy"), F.col("total")), F.lit(0.0)).alias("pct"))


def _nearest(spec: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (series_id, target, ...) with the bin next to each: equal spacing tells it without a search."""
    ends = spec.groupBy(KEY).agg(F.max(F.when(F.col("bin") == 1, F.col("freq"))).alias("step"), F.max("bin").alias("last"))
    at = targets.join(ends, KEY).withColumn("bin", F.least(F.ceil(F.col("target") / F.col("step") - 0.5), F.col("last")).cast("long"))
    return at.join(spec.select(KEY, "bin", "freq", "mag", "n"), [KEY, "bin"])


def local_median(spec: DataFrame, half: int) -> DataFrame:
    return spec.withColumn("around", F.percentile("mag", F.lit(0.5)).over(Window.partitionBy(KEY).orderBy("bin").rowsBetween(-half, half)))


def harmonics(spec: DataFrame, fs: float = 1.0, count: int = 10, fundamental: DataFrame | None = None) -> DataFrame:
    """series_id, fundamental, order, expected, freq, mag, found: multiples of each fundamental.

    Found: twice the median of the 11 bins around it, and within two bins of the unpadded
    transform or 2 % of the fundamental. fundamental: series_id, freq (default: the strongest peak
    that is not at zero).
    """
    if fundamental is None:
        base = peaks(spec).where("freq > 0").groupBy(KEY).agg(F.min_by("freq", "rank").alias("f0"), F.min_by("mag", "rank").alias("a0"))
    else:
        base = _nearest(spec, fundamental.select(KEY, F.col("freq").alias("target"))).select(KEY, F.col("target").alias("f0"), F.col("mag").alias("a0"))
    rows = base.withColumn("order", F.explode(F.sequence(F.lit(2), F.lit(count)))).withColumn("target", F.col("order") * F.col("f0")).where(F.col("target") <= fs / 2)
    rows = _nearest(local_median(spec, 5).select(KEY, "n", "bin", "freq", "mag"), rows).join(local_median(spec, 5).select(KEY, "bin", "around"), [KEY, "bin"])
    limit = F.greatest(2 * fs / F.col("n"), 0.02 * F.col("f0"))
    found = (F.col("mag") > 2 * F.col("around")) & (F.abs(F.col("freq") - F.col("target")) < limit)
    return rows.select(KEY, F.col("f0").alias("fundamental"), F.col("a0").alias("amplitude"), "order", F.col("target").alias("expected"), "freq", "mag", found.alias("found"))


def thd(found: DataFrame) -> DataFrame:
    """series_id, n_harmonics, thd in percent of the fundamental; null without any."""
    hit = F.col("found")
    out = found.groupBy(KEY).agg(F.max("amplitude").alias("a0"), F.count_if(hit).alias("n_harmonics"), F.sum(F.when(hit, F.col("mag") ** 2)).alias("s"))
    return out.select(KEY, "n_harmonics", (100 * ratio(F.sqrt("s"), F.col("a0"))).alias("thd"))


def noise_floor(signals: DataFrame, spec: DataFrame) -> DataFrame:
    """series_id, floor_db, peak_db, range_db, snr_db, slope, slope_r2: median density, peaks over the rest, colour."""
    p = F.when(F.col("psd") > 0, F.col("psd"))
    lf, lp = F.log10(F.when(F.col("freq") > 0, F.col("freq"))), F.log10(p)
    n = spec.groupBy(KEY).agg(F.percentile(p, F.lit(0.5)).alias("m"), F.max(p).alias("x"), F.regr_slope(lp, lf).alias("slope"), F.regr_r2(lp, lf).alias("slope_r2"))
    signal = peaks(spec, 5).groupBy(KEY).agg((F.sum(F.col("mag") ** 2) / 2).alias("s"))
    power = signals.groupBy(F.col(KEY).cast("string").alias(KEY)).agg(F.avg(F.col("value") ** 2).alias("w"))
    out = n.join(signal, KEY, "left").join(power, KEY)
    rest = F.greatest(F.col("w") - F.col("s"), F.lit(0.0))
    snr = F.when(F.col("s").isNotNull(), F.when(rest > 0, 10 * F.log10(F.col("s") / F.nullif(rest, F.lit(0.0)))).otherwise(float("inf")))
    return out.select(KEY, (10 * F.log10("m")).alias("floor_db"), (10 * F.log10("x")).alias("peak_db"), (10 * F.log10(F.col("x") / F.col("m"))).alias("range_db"), snr.alias("snr_db"), "slope", "slope_r2")


def noise_colour(slope: Column) -> Column:
    return F.when(F.abs(slope) < 0.3, "white").when((slope > -1.5) & (slope < -0.5), "pink").when(slope < -1.5, "brown").otherwise("other")


def window_compare(signals: DataFrame, fs: float = 1.0) -> DataFrame:
    """series_id, window, dynamic_range_db (peak over median, zero frequency apart) for each window."""
    out = None
    for name in WINDOWS:
        s = spectrum(signals, fs, name).where("bin > 0").groupBy(KEY).agg(F.max("mag").alias("a"), F.percentile("mag", F.lit(0.5)).alias("m"))
        s = s.select(KEY, F.lit(name).alias("window"), (20 * F.log10(F.col("a") / F.greatest(F.col("m"), F.lit(TINY)))).alias("dynamic_range_db"))
        out = s if out is None else out.union(s)
    return out


def _db(x: Column | str) -> Column:
    return 10 * F.log10((F.col(x) if isinstance(x, str) else x) + TINY)


def spectral_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """series_id, distance: root mean square difference of the densities in decibels over common bins."""
    both = a.select(KEY, "bin", F.col("psd").alias("p")).join(b.select(KEY, "bin", F.col("psd").alias("q")), [KEY, "bin"])
    return both.groupBy(KEY).agg(F.sqrt(F.avg((_db("p") - _db("q")) ** 2)).alias("distance"))


# --- pairs and frames (Welch's method) --------------------------------------------------------


def _segments(x: np.ndarray, size: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[::step]


def welch_cross(x: np.ndarray, y: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, ...]:
    """Frequencies and averaged auto- and cross-spectra of half-overlapping, centred, tapered segments."""
    w = window_values("hann", size + 1)[:-1]
    a, b = (np.fft.rfft((s - s.mean(axis=1, keepdims=True)) * w, axis=1) for s in (_segments(x, size, size // 2), _segments(y, size, size // 2)))
    scale = 1 / (fs * (w**2).sum())
    pxx, pyy, pxy = (np.abs(a) ** 2).mean(axis=0) * scale, (np.abs(b) ** 2).mean(axis=0) * scale, (np.conj(a) * b).mean(axis=0) * scale
    for p in (pxx, pyy, pxy):
        p[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / fs), pxx, pyy, pxy


def welch_density(signals: DataFrame, fs: float = 1.0, size: int = 0) -> DataFrame:
    """series_id, n, bin, freq, psd of each signal of 8 values or more, averaged over half-overlapping segments.

    size: values in a segment; 0: as many as transfer_function takes. Shorter signals are one segment.
    """

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = table["value"].to_numpy()
        own = min(len(x), size or max(256, next_pow2(len(x) // 8)))
        f, p, _, _ = welch_cross(x, x, fs, own) if len(x) >= 8 else (np.empty(0),) * 4
        return pa.table({KEY: pa.array([table[KEY][0].as_py()] * len(f), pa.string()), "n": np.full(len(f), len(x)), "bin": np.arange(len(f)), "freq": f, "psd": p})

    rows = signals.select(F.col(KEY).cast("string"), F.col("t").cast("long"), F.col("value").cast("double")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return rows.groupBy(KEY).applyInArrow(one, "series_id string, n long, bin long, freq double, psd double")


def transfer_function(pairs: DataFrame, fs: float = 1.0) -> DataFrame:
    """series_id, freq, gain_db, phase_deg, coherence of u (input) to y (output); signals of 64 values or more."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x, y = table["u"].to_numpy(), table["y"].to_numpy()
        names = ("freq", "gain_db", "phase_deg", "coherence")
        if len(x) < 64:
            return pa.table({KEY: pa.array([], pa.string()), **{k: pa.array([], pa.float64()) for k in names}})
        f, pxx, pyy, pxy = welch_cross(x, y, fs, min(len(x), max(256, next_pow2(len(x) // 8))))
        h = pxy / (pxx + TINY)
        cols = (f, 20 * np.log10(np.abs(h) + TINY), np.degrees(np.angle(h)), np.abs(pxy) ** 2 / (pxx * pyy + TINY))
        return pa.table({KEY: pa.array([table[KEY][0].as_py()] * len(f), pa.string()), **dict(zip(names, cols, strict=True))})

    rows = pairs.select(F.col(KEY).cast("string"), "t", "y", "u").where("y is not null and u is not null and not isnan(y) and not isnan(u)")
    return rows.groupBy(KEY).applyInArrow(one, "series_id string, freq double, gain_db double, phase_deg double, coherence double")


def resonances(frf: DataFrame, prominence: float = 6.0, top: int = 5) -> DataFrame:
    """series_id, freq, gain_db, prominence of gain peaks that stand out by prominence decibels, by frequency.

    A peak's prominence is its height over the higher of the lowest points that part it from
    higher gains on either side.
    """

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("freq")
        f, g = table["freq"].to_numpy(), table["gain_db"].to_numpy()
        out = []
        for i in np.flatnonzero((g[1:-1] > g[:-2]) & (g[1:-1] > g[2:])) + 1:
            left, right = np.flatnonzero(g[:i] > g[i]), np.flatnonzero(g[i + 1 :] > g[i])
            a = g[(left[-1] if len(left) else 0) : i].min()
            b = g[i + 1 : (i + 1 + right[0] if len(right) else len(g))].min()
            if g[i] - max(a, b) >= prominence:
                out.append((f[i], g[i], g[i] - max(a, b)))
        out = np.array(out[:top]).reshape(-1, 3)
        return pa.table({KEY: pa.array([table[KEY][0].as_py()] * len(out), pa.string()), "freq": out[:, 0], "gain_db": out[:, 1], "prominence": out[:, 2]})

    return frf.select(KEY, "freq", "gain_db").groupBy(KEY).applyInArrow(one, "series_id string, freq double, gain_db double, prominence double")


def frames(signals: DataFrame, fs: float = 1.0, size: int = 0) -> DataFrame:
    """series_id, frame, time, power, centroid of each frame of a short-time transform (three quarters overlap)."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = table["value"].to_numpy()
        n = len(x)
        names = ("time", "power", "centroid")
        if n < 128:
            return pa.table({KEY: pa.array([], pa.string()), "frame": pa.array([], pa.int64()), **{k: pa.array([], pa.float64()) for k in names}})
        own = size or min(n // 4, max(128, next_pow2(n // 16)))
        w = window_values("hann", own + 1)[:-1]
        step = max(1, own - own * 3 // 4)
        p = np.abs(np.fft.rfft(_segments(x, own, step) * w, axis=1) / w.sum()) ** 2
        f, total = np.fft.rfftfreq(own, 1 / fs), p.sum(axis=1)
        cols = ((np.arange(len(p)) * step + own / 2) / fs, total, (p @ f) / np.maximum(total, TINY))
        return pa.table({KEY: pa.array([table[KEY][0].as_py()] * len(p), pa.string()), "frame": np.arange(len(p)), **dict(zip(names, cols, strict=True))})

    return signals.select(F.col(KEY).cast("string"), "t", "value").groupBy(KEY).applyInArrow(one, "series_id string, frame long, time double, power double, centroid double")


def transients(table: DataFrame) -> DataFrame:
    """Frames behind which the power changes by more than three spreads from the mean change."""
    w, all_ = Window.partitionBy(KEY).orderBy("frame"), Window.partitionBy(KEY)
    d = table.withColumn("step", F.lead("power").over(w) - F.col("power")).where("step is not null")
    z = (F.col("step") - F.avg("step").over(all_)) / F.greatest(F.stddev_pop("step").over(all_), F.lit(TINY))
    return d.withColumn("z", z).where("abs(z) > 3").select(KEY, "frame", "time", "z")


# --- findings ---------------------------------------------------------------------------------


def analysis(signals: DataFrame, fs: float = 1.0, reference: DataFrame | None = None, pairs: DataFrame | None = None, shaft_hz: float | None = None, faults: dict[str, float] | None = None) -> DataFrame:
    """Findings of all phases; signals under 8 values are rejected and have no others."""
    signals = signals.select(F.col(KEY).cast("string").alias(KEY), "t", "value")
    n = signals.groupBy(KEY).agg(F.count("value").alias("n"), F.sqrt(F.avg(F.col("value") ** 2)).alias("rms"), F.max(F.abs("value")).alias("peak"), kurtosis().alias("kurt"))
    short = n.where("n < 8")
    rejected = phase(short, 1, "spectral_profile", [check("length", ladder([], ("REJECT", "CRITICAL")), F.col("n"))])
    sound = signals.join(short.select(KEY), KEY, "left_anti")
    spec = spectrum(sound, fs)
    strongest = peaks(spec)
    top = strongest.groupBy(KEY).agg(F.count("*").alias("n_peaks"), F.min_by("freq", "rank").alias("top_freq"), F.max("freq").alias("far"), F.max("mag").alias("top_mag"))
    dc = spec.where("bin = 0").select(KEY, F.col("mag").alias("dc"))
    s = n.where("n >= 8").join(shape(spec), KEY).join(dc, KEY).join(top, KEY, "left").join(noise_floor(sound, spec), KEY)
    found = harmonics(spec, fs)
    s = s.join(thd(found), KEY, "left")
    base = found.groupBy(KEY).agg(F.max("fundamental").alias("f0"), F.max("amplitude").alias("a0"))
    s = s.join(base, KEY, "left")
    gap = F.abs(F.col("freq") - F.col("f0"))
    side = strongest.join(base, KEY).where((gap > 0) & (gap < 0.15 * F.col("f0")) & (F.col("mag") > 0.05 * F.col("a0"))).groupBy(KEY).agg(F.count("*").alias("sidebands"))
    s = s.join(side, KEY, "left").withColumn("sidebands", F.coalesce("sidebands", F.lit(0)))
    off = F.coalesce(ratio(F.col("dc"), F.col("rms")), F.lit(0.0))
    any_peak, crest, half = F.col("n_peaks") > 0, F.coalesce(ratio(F.col("peak"), F.col("rms")), F.lit(0.0)), fs / 2
    d, x, k = F.col("thd"), F.col("snr_db"), F.col("kurt")
    out = rejected.union(phase(s, 1, "spectral_profile", [
        check("fft_config", ladder([]), fs / F.col("n")),
        check("dominant_frequencies", ladder([(~F.coalesce(any_peak, F.lit(False)), "WARN", "MEDIUM")]), F.col("top_freq")),
        check("dc_offset", ladder([(off > 10, "WARN", "MEDIUM")]), off),
        check("spectral_flatness", ladder([]), F.col("flatness")),
        check("spectral_centroid", ladder([]), F.col("centroid")),
    ]))
    out = out.union(phase(s, 2, "harmonic_analysis", [
        skipped("harmonics", F.col("n_peaks").isNull()),
        check("fundamental", ladder([]), F.col("f0"), F.col("f0").isNotNull()),
        check("harmonics_detected", ladder([]), F.col("n_harmonics"), F.col("f0").isNotNull()),
        check("thd", ladder([(d > 50, "WARN", "HIGH"), (d > 10, "WARN", "MEDIUM")]), d, F.col("f0").isNotNull()),
        check("sidebands", ladder([(F.col("sidebands") > 0, "WARN", "MEDIUM")]), F.col("sidebands"), F.col("f0").isNotNull()),
    ]))
    w = window_compare(sound, fs).groupBy(KEY).agg(F.max("dynamic_range_db").alias("best"), F.max(F.when(F.col("window") == "hann", F.col("dynamic_range_db"))).alias("hann"), F.max(F.when(F.col("window") == "boxcar", F.col("dynamic_range_db"))).alias("boxcar"))
    ws, better, long = s.select(KEY, "n", "far").join(w, KEY), F.col("hann") - F.col("boxcar"), F.col("n") >= 64
    out = out.union(phase(ws, 3, "windowing_quality", [
        skipped("windowing", ~long),
        check("window_comparison", ladder([]), F.col("best"), long),
        check("leakage_detected", ladder([(better > 10, "WARN", "MEDIUM")]), better, long),
        check("freq_resolution", ladder([]), fs / F.col("n"), long),
        check("nyquist_proximity", ladder([(F.col("far") > 0.9 * half, "WARN", "HIGH")]), F.col("far"), long & F.col("far").isNotNull()),
    ]))
    out = out.union(phase(s, 4, "noise_floor", [
        check("noise_floor_level", ladder([]), F.col("floor_db")),
        check("snr", ladder([(x < 3, "WARN", "HIGH"), (x < 10, "WARN", "MEDIUM")]), x, x.isNotNull()),
        check("noise_colour", ladder([]), F.col("slope"), F.col("slope").isNotNull()),
    ]))
    out = out.union(phase(s, 5, "bandwidth", [
        check("spectral_rolloff", ladder([]), F.col("rolloff_95")),
        check("oversampling", ladder([], ("WARN", "LOW")), half / F.nullif("rolloff_99", F.lit(0.0)), F.col("rolloff_99") < 0.2 * half),
        check("spectral_spread", ladder([]), F.col("spread")),
    ]))
    if pairs is not None:
        frf = transfer_function(pairs, fs)
        t = frf.groupBy(KEY).agg(F.avg("coherence").alias("c"), F.max("gain_db").alias("g"), F.max_by("phase_deg", "gain_db").alias("p"))
        t = t.join(resonances(frf).groupBy(KEY).agg(F.count("*").alias("sharp")), KEY, "left").withColumn("sharp", F.coalesce("sharp", F.lit(0)))
        out = out.union(phase(t, 6, "system_identification", [
            check("coherence", ladder([(F.col("c") < 0.3, "FAIL", "HIGH"), (F.col("c") < 0.6, "WARN", "MEDIUM")]), F.col("c")),
            check("transfer_function", ladder([]), F.col("g")),
            check("resonances", ladder([(F.col("sharp") > 0, "WARN", "MEDIUM")]), F.col("sharp")),
            check("phase_at_peak", ladder([]), F.col("p")),
        ]))
    if reference is not None:
        out = out.union(anomaly(spec, spectrum(reference, fs), fs))
    fr = frames(sound, fs)
    cv = lambda c: F.coalesce(ratio(F.stddev_pop(c), F.avg(c)), F.lit(0.0))
    e = fr.groupBy(KEY).agg(F.count("*").alias("k"), cv("power").alias("v"), cv("centroid").alias("c")).join(transients(fr).groupBy(KEY).agg(F.count("*").alias("jumps")), KEY, "left").withColumn("jumps", F.coalesce("jumps", F.lit(0)))
    out = out.union(phase(n.where("n >= 8").select(KEY, "n").join(e, KEY, "left"), 8, "time_frequency", [
        skipped("stft", F.col("k").isNull()),
        check("spectral_stationarity", ladder([(F.col("v") > 0.5, "WARN", "HIGH"), (F.col("v") > 0.2, "WARN", "LOW")]), F.col("v"), F.col("k") >= 4),
        check("centroid_evolution", ladder([(F.col("c") > 0.15, "WARN", "MEDIUM")]), F.col("c"), F.col("k") >= 4),
        check("transients", ladder([(F.col("jumps") > 0, "WARN", "MEDIUM")]), F.col("jumps"), F.col("k") > 4),
    ]))
    out = out.union(phase(s, 9, "system_health", [
        check("rms_level", ladder([]), F.col("rms")),
        check("crest_factor", ladder([(crest > 6, "WARN", "HIGH"), (crest > 4, "WARN", "MEDIUM")]), crest),
        check("kurtosis", ladder([(k > 7, "WARN", "HIGH"), (k > 4, "WARN", "MEDIUM")]), k),
        check("spectral_fingerprint", ladder([]), F.col("n_peaks"), F.col("n_peaks").isNotNull()),
    ]))
    if shaft_hz or faults:
        out = out.union(machine(spec, shaft_hz, faults or {}, fs))
    return out


def anomaly(spec: DataFrame, ref: DataFrame, fs: float = 1.0) -> DataFrame:
    """Phase 7: distance from a reference, bands that moved, peaks that are new. The bins must be the same."""
    d = spectral_distance(spec, ref)
    both = band_energy(spec, fs).select(KEY, "band", F.col("energy").alias("a")).join(band_energy(ref, fs).select(KEY, "band", F.col("energy").alias("b")), [KEY, "band"])
    moved = F.when(F.col("b") > 0, 10 * F.log10((F.col("a") + TINY) / (F.col("b") + TINY))).otherwise(0.0)
    m = both.withColumn("db", moved).groupBy(KEY).agg(F.count_if(F.abs("db") > 6).alias("moved"), F.max(F.abs("db")).alias("most"))
    old = peaks(ref, 15).groupBy(KEY).agg(F.collect_list(F.round("freq", 1)).alias("old"))  # 15 numbers at most
    width = spec.groupBy(KEY).agg(F.max("n").alias("n"))
    new = peaks(spec, 15).join(width, KEY).join(old, KEY, "left")
    far = ~F.exists(F.coalesce("old", F.array().cast("array<double>")), lambda f: F.abs(F.col("freq") - f) <= 3 * fs / F.col("n"))
    p = new.where(far & (F.col("mag") > 0)).groupBy(KEY).agg(F.count("*").alias("new"))
    s = d.join(m, KEY).join(p, KEY, "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return phase(s, 7, "spectral_anomaly", [
        check("spectral_distance", ladder([(F.col("distance") > 20, "FAIL", "HIGH"), (F.col("distance") > 10, "WARN", "MEDIUM")]), F.col("distance")),
        check("band_energy_shift", ladder([(F.col("moved") > 0, "WARN", "HIGH")]), F.col("most")),
        check("new_peaks", ladder([(F.col("new") > 0, "WARN", "MEDIUM")]), F.col("new")),
    ])


def machine(spec: DataFrame, shaft_hz: float | None, faults: dict[str, float], fs: float = 1.0) -> DataFrame:
    """Shaft orders and fault frequencies held against the median of 41 bins around each."""
    keys = spec.select(KEY).distinct()
    out = None
    if shaft_hz:
        orders = F.explode(F.array(*[F.struct(F.lit(o).alias("order"), F.lit(o * shaft_hz).alias("target")) for o in range(1, 6) if o * shaft_hz <= fs / 2]))
        at = _nearest(spec, keys.select(KEY, orders.alias("x")).select(KEY, "x.*"))
        s = at.groupBy(KEY).agg(*[F.max(F.when(F.col("order") == o, F.col("mag"))).alias(f"a{o}") for o in (1, 2)])
        two = F.col("a2") / F.greatest(F.col("a1"), F.lit(TINY))
        out = phase(s, 9, "system_health", [check("shaft_harmonics", ladder([]), F.col("a1")), check("misalignment_indicator", ladder([], ("WARN", "MEDIUM")), two, two > 0.5)])
    if faults:
        rows = F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), F.lit(float(v)).alias("target")) for k, v in faults.items() if v <= fs / 2]))
        at = _nearest(spec, keys.select(KEY, rows.alias("x")).select(KEY, "x.*")).join(local_median(spec, 20).select(KEY, "bin", "around"), [KEY, "bin"])
        at = at.withColumn("p", F.col("mag") / F.greatest(F.col("around"), F.lit(TINY)))
        judged = ladder([(F.col("p") > 5, "WARN", "HIGH"), (F.col("p") > 3, "WARN", "MEDIUM")])
        f = at.select(KEY, F.lit(9).alias("phase_no"), F.lit("system_health").alias("phase"), F.concat(F.lit("bearing_"), "fault").alias("check"), judged["verdict"].alias("verdict"), judged["severity"].alias("severity"), F.col("p").alias("value"))
        out = f if out is None else out.union(f)
    return out


