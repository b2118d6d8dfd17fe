"""Log lines, option strings, subtitle text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: terminal escapes, the progress bar, the rebuilt-graph message
ANSI = r"\x1b(?:\[[0-9;?]*[A-Za-z]|\][^\x07\x1b]*(?:\x07|\x1b\\)|\(B|\)[0-9A-B])"
BAR = r"([\d.]+)\s*%\s+(\d+)/(\d+)\s+\(([\d.]+)\s*fps"
REBUILT = "Reconfiguring filter graph"
GRAIN_KEYS = ["film-grain", "film-grain-denoise", "fgs-table"]
SRT_JUNK = r"</?font[^>]*>|\{\\an\d\}"


def last_redraw(line: Column) -> Column:
    """A terminal line as it was last drawn, without escapes."""
    return F.regexp_replace(F.element_at(F.split(line, "\r"), -1), ANSI, "")


def progress_stats(line: Column) -> Column:
    """struct(pct, done, total, fps) of the last valid progress bar on a line, or NULL."""
    def of(i: int) -> Column:
        return F.regexp_extract_all(line, F.lit(BAR), F.lit(i))

    hits = F.zip_with(F.zip_with(of(1), of(2), lambda p, d: F.struct(p.alias("p"), d.alias("d"))),
                      F.zip_with(of(3), of(4), lambda t, f: F.struct(t.alias("t"), f.alias("f"))),
                      lambda a, b: F.struct(a["p"].try_cast("double").alias("pct"), a["d"].try_cast("long").alias("done"),
                                            b["t"].try_cast("long").alias("total"), b["f"].try_cast("double").alias("fps")))
    valid = F.filter(hits, lambda h: (h["pct"] >= 0) & (h["pct"] <= 100) & h["fps"].isNotNull())
    return F.try_element_at(valid, F.lit(-1))


def rebuild_reason(log: Column) -> Column:
    """Why a filter graph was rebuilt mid-run, NULL if it was not; a metadata line
    of the input dump that happens to say the same does not count."""
    lines = F.filter(F.split(log, r"[\r\n]"), lambda s: s.contains(REBUILT) & ~s.rlike(r"^[ \t]+[^:\r\n]*: " + REBUILT))
    rest = F.substring_index(F.try_element_at(lines, F.lit(1)), REBUILT, 1)
    line = F.try_element_at(lines, F.lit(1))
    after = F.substr(line, F.length(rest) + F.length(F.lit(REBUILT)) + 1)
    reason = F.trim(F.when(after.startswith(" because "), F.substr(after, F.lit(10))).otherwise(""))
    return F.when(line.isNotNull(), F.when(reason == "", "unspecified").otherwise(reason))


def parse_target(text: Column) -> Column:
    """"75" or "75-85" as struct(lo, hi, error)."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*(?:[-–]\s*(\d+(?:\.\d+)?))?\s*$"
    lo = F.regexp_extract(text, pattern, 1).try_cast("double")
    hi = F.regexp_extract(text, pattern, 2).try_cast("double")
    error = F.when(lo.isNull(), "invalid").when(hi < lo, "inverted")
    return F.struct(F.when(error.isNull(), lo).alias("lo"), F.when(error.isNull(), hi).alias("hi"), error.alias("error"))


def _dash(token: Column) -> Column:
    return F.regexp_replace(token, "^-+", "")


def parse_flags(text: Column) -> Column:
    """Option string (`k=v`, `--k v`) as a map; a later value of a key wins."""
    toks = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    n = F.size(toks)

    def value_of(t: Column, i: Column) -> Column:
        nxt = F.try_element_at(toks, i + 2)
        return (F.when(t.contains("="), F.struct(_dash(F.substring_index(t, "=", 1)).alias("k"),
                                                 F.substr(t, F.locate("=", t) + 1).alias("v")))
                .when(t.startswith("-") & (i + 1 < n) & ~nxt.startswith("-"), F.struct(_dash(t).alias("k"), nxt.alias("v"))))

    # a token taken as the value of the option before it is not an option itself
    def taken(t: Column, i: Column) -> Column:
        prev = F.try_element_at(toks, F.greatest(i, F.lit(1)))
        return (i > 0) & prev.startswith("-") & ~prev.contains("=") & ~t.startswith("-")

    pairs = F.transform(toks, lambda t, i: F.when(~taken(t, i), value_of(t, i)))
    pairs = F.filter(pairs, lambda p: p.isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def _is_grain(token: Column) -> Column:
    return _dash(F.substring_index(token, "=", 1)).isin(GRAIN_KEYS)


def strip_grain_flags(text: Column) -> Column:
    """struct(kept, gone): an encoder's own film-grain options taken out of an option string."""
    toks = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")

    def packed(t: Column) -> Column:
        return t.contains(":") & t.contains("=") & ~t.startswith("-")

    def opens(t: Column) -> Column:
        """A grain option whose value is the next token."""
        return ~packed(t) & _is_grain(t) & ~t.contains("=")

    def is_value(t: Column, i: Column) -> Column:
        prev = F.try_element_at(toks, F.greatest(i, F.lit(1)))
        return (i > 0) & opens(prev) & ~t.startswith("-")

    def kept(t: Column, i: Column) -> Column:
        rest = F.array_join(F.filter(F.split(t, ":"), lambda x: ~_is_grain(x)), ":")
        return F.when(packed(t), F.when(rest != "", rest)).when(~_is_grain(t) & ~is_value(t, i), t)

    def gone(t: Column, i: Column) -> Column:
        nxt = F.try_element_at(toks, i + 2)
        with_value = F.when(nxt.isNotNull() & ~nxt.startswith("-"), F.concat_ws(" ", t, nxt)).otherwise(t)
        return (F.when(packed(t), F.filter(F.split(t, ":"), _is_grain))
                .when(opens(t), F.array(with_value)).when(_is_grain(t), F.array(t)).otherwise(F.array().cast("array<string>")))

    left = F.array_compact(F.transform(toks, kept))
    return F.struct(F.array_join(left, " ").alias("kept"), F.flatten(F.transform(toks, gone)).alias("gone"))


def json_or_text(raw: Column, schema: str) -> Column:
    """struct(value, raw): parsed JSON, or the text as it is when it does not parse."""
    value = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    return F.struct(F.when(F.try_parse_json(raw).isNotNull(), value).alias("value"), raw.alias("raw"))


def srt_timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm, not below zero."""
    ms = F.bround(F.greatest(seconds.cast("double"), F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60,
                           F.floor(ms / 1000) % 60, ms % 1000)


def sanitise_srt(text: Column) -> Column:
    """Without font wrappers and position codes; NULL when nothing is left."""
    clean = F.regexp_replace(text, SRT_JUNK, "")
    return F.when(F.trim(F.regexp_replace(clean, r"\s+", " ")) != "", clean)


def clean_text(text: Column) -> Column:
    """Each line trimmed, runs of blanks collapsed, blank lines dropped; line breaks stay."""
    lines = F.split(F.regexp_replace(text, "\\f", "\n"), "\r\n|[\\n\\r\\x0B\\x1C-\\x1E\\u0085\\u2028\\u2029]")
    trimmed = F.transform(lines, lambda s: F.regexp_replace(
        F.regexp_replace(s, "[ \\t\\u00A0]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(trimmed, lambda s: s != ""), "\n")
