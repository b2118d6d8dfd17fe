"""Sizes, durations and settings as text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: instances' memory relative to four threads; (slope, offset) of the memory models
LP_MEMORY = {1: 0.55, 2: 0.65, 3: 0.80, 4: 1.00, 5: 1.15, 6: 1.35}
MEMORY_MODEL = {"encode": (0.2455, -0.368), "probe": (0.145, -0.0105)}


def size_to_mb(text: Column) -> Column:
    """"1234 KiB", "12 MiB" or a bare number (KiB) in MB; 0 for anything else."""
    parts = F.split(F.trim(text), r"\s+")
    n = F.try_element_at(parts, F.lit(1)).try_cast("double")
    unit = F.lower(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("KiB")))
    scale = F.when(unit == "b", 1 / 1048576.0).when(unit == "mib", 1.0).when(unit == "gib", 1024.0).otherwise(1 / 1024.0)
    return F.coalesce(n * scale, F.lit(0.0))


def fmt_bytes(n: Column) -> Column:
    """B to TB in steps of 1024, one decimal from KB on."""
    v = n.cast("double")
    out = F.format_string("%d B", F.floor(v + 0.5).cast("long"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = F.when(v >= 1024.0**power, F.format_string("%.1f " + unit, v / 1024.0**power)).otherwise(out)
    return out


def fmt_duration(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = F.greatest(F.lit(0), F.floor(seconds.cast("double") + 0.5).cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    text = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))
    return F.when(seconds.isNotNull(), text)


def fmt_ratio(before: Column, after: Column) -> Column:
    """Share saved as a signed percentage with an arrow; empty when not known."""
    pct = F.floor((1 - after / before) * 100 + 0.5).cast("long")
    text = (F.when(pct > 0, F.format_string("↘%d%%", pct)).when(pct < 0, F.format_string("↗%d%%", -pct))
            .otherwise("±0%"))
    return F.when((before > 0) & (after > 0), text).otherwise("")


def eta_text(done: Column, total: Column, fps: Column, stage: Column) -> Column:
    """Time left in a stage that counts frames, else empty."""
    shown = (total > 0) & (fps > 0) & ~F.coalesce(stage, F.lit("")).isin("scenedetect", "probing", "verifying")
    return F.when(shown, fmt_duration(F.greatest(F.lit(0), total - done) / fps)).otherwise("")


def plain_decimal(x: Column) -> Column:
    """Six decimals, trailing zeros cut (one kept), never scientific."""
    text = F.regexp_replace(F.format_string("%.6f", x.cast("double")), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def estimate_memory(frames: Column, megapixels: Column, threads: Column, phase: str = "encode") -> Column:
    """Peak memory (GB) of one instance: logarithmic in frames, linear in megapixels."""
    slope, offset = MEMORY_MODEL[phase]
    demand = F.greatest(F.lit(0.30), F.lit(slope) * F.log(F.greatest(frames, F.lit(8)).cast("double")) + F.lit(offset))
    table = F.create_map(*[F.lit(v) for kv in LP_MEMORY.items() for v in kv])
    ratio = F.coalesce(F.try_element_at(table, threads.cast("int")), F.lit(1.0))
    return (F.lit(0.40) + megapixels * demand * ratio) * F.lit(1.10)


def megapixels(width: Column, height: Column) -> Column:
    px = F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0))
    return F.when(px > 0, F.greatest(F.lit(0.5), px / 1e6)).otherwise(2.0)
