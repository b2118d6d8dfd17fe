"""Subtitle streams and cues over a whole library.

streams  file, index, pos, codec_type, codec, flags, default, forced, language, title, tags, nb_frames, duration_ts
cues     track_id, cue_idx, start, end, text, rung
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlake.functions.text import clean_text, srt_timestamp
from shotlake.plans import exact_quantile, ordered_scan, position, settle

# fixed values: codecs and language tags the rules look at, and codec ids of the second tool
ASS_CODECS = ["ass", "ssa"]
IMAGE_CODECS = ["hdmv_pgs_subtitle"]
ENGLISH_TAGS = ["eng", "en", "english", "en-us", "en-gb", "eng-us"]
CODEC_IDS = {
    "subrip": ["S_TEXT/UTF8"],
    "ass": ["S_TEXT/ASS", "S_TEXT/SSA"],
    "ssa": ["S_TEXT/SSA", "S_TEXT/ASS"],
    "webvtt": ["S_TEXT/WEBVTT"],
    "hdmv_pgs_subtitle": ["S_HDMV/PGS"],
    "hdmv_text_subtitle": ["S_HDMV/TEXTST"],
    "dvd_subtitle": ["S_VOBSUB"],
    "dvb_subtitle": ["S_DVBSUB"],
}
TICKS = 90000.0
# fixed values: quality gates (signal, comparison, bound) and the word count under which words are not judged
GATES = [
    ("empty_rate", "<=", 0.010),
    ("timing_parse_sane", "==", 1.0),
    ("overlap_rate", "<=", 0.020),
    ("bar_rate", "<=", 1.0),
    ("fallback_rate", "<=", 0.050),
    ("nonascii_rate", "<=", 0.005),
    ("chars_per_cue", ">=", 8.0),
    ("oov_rate", "<=", 0.060),
]
MIN_TOKENS = 300

FILE = ("file",)
TRACK = ("track_id",)
STREAMS = 1 << 12
CUES = 1 << 14


# --- streams -------------------------------------------------------------------

def empty_streams(streams: DataFrame, key: Sequence[str] = FILE) -> DataFrame:
    """Whether each subtitle stream holds no cues: true or false only on a signal
    that counts them, NULL (keep) for anything missing or contradictory.

    Matroska counts in NUMBER_OF_FRAMES tags; elsewhere more than one sample
    means cues, and a zero duration means none, if some stream of the file
    states a duration at all. `matroska` tells the container.
    """
    digits = r"^\s*\d+\s*$"
    stated = F.trim("duration_ts").rlike(r"^\d+$") & (F.trim("duration_ts").try_cast("decimal(38,0)") > 0)
    # a window over the file and no join: the streams are shuffled once, and not at all if they come by file
    known = streams.dropna("any", None, [*key]).withColumn("_stated", F.coalesce(stated, F.lit(False)))
    timed = ordered_scan(known, key, ["pos"], width=STREAMS, totals={"_timed": ("max", "_stated")})
    subs = timed.filter(F.col("codec_type") == "subtitle")
    counts = F.map_values(F.map_filter("tags", lambda k, v: F.lower(k).rlike(r"^number_of_frames(-.*)?$")))
    numbers, nb = F.col("_numbers"), F.trim("nb_frames")
    # columns, so that each pattern is tried once a row and not in every branch that asks for it
    subs = subs.withColumns({
        "_numbers": F.transform(counts, lambda v: F.when(v.rlike(digits), F.trim(v).try_cast("long"))),
        "_many": F.coalesce(nb.rlike(r"^\d+$") & (nb.try_cast("long") > 1), F.lit(False)),
        "_told": F.coalesce(F.trim("duration_ts").rlike(r"^\d+$"), F.lit(False))})
    subs = subs.withColumns({"_broken": F.exists(numbers, lambda n: n.isNull()), "_most": F.array_max(numbers)})
    broken, most, stated = F.col("_broken"), F.col("_most"), F.col("_stated")
    tagged = F.when(broken, None).when(F.size(numbers) == 0, None).otherwise(most == 0)
    sampled = F.when(F.col("_many"), False).when(~F.col("_told"), None).when(stated, False).when(~F.col("_timed"), None).otherwise(True)
    why = F.when(F.col("matroska"), F.when(broken, "unparseable count").when(
        F.size(numbers) == 0, "no count").otherwise(F.concat(F.lit("count="), most.cast("string")))).otherwise(
        F.when(F.col("_many"), "samples").when(~F.col("_told"), "no duration").when(stated, "duration").when(
            ~F.col("_timed"), "file states no duration").otherwise("zero duration"))
    return subs.withColumns({"empty": F.when(F.col("matroska"), tagged).otherwise(sampled), "why": why}).drop(
        "_timed", "_stated", "_numbers", "_many", "_told", "_broken", "_most")


def keep_streams(streams: DataFrame, drop: bool = True, key: Sequence[str] = FILE) -> DataFrame:
    """Streams that stay, with their new position; only an explicit TRUE is dropped."""
    kept = streams.filter(~F.coalesce("empty", F.lit(False))) if drop else streams
    return position(kept, key, ["pos"], STREAMS, "new_pos")


def companion_candidates(streams: DataFrame) -> DataFrame:
    """Streams that get a text copy: styled text, and English image subtitles; never an empty one."""
    styled = F.col("codec").isin(ASS_CODECS)
    image = F.col("codec").isin(IMAGE_CODECS) & F.lower(F.trim("language")).isin(ENGLISH_TAGS)
    return streams.filter((styled | image) & ~F.coalesce("empty", F.lit(False))).withColumn(
        "companion", F.when(image, "ocr").otherwise("text"))


def move_default_flag(kept: DataFrame, companions: DataFrame, key: Sequence[str] = FILE) -> DataFrame:
    """Flags of every output subtitle track. A companion takes `default` from the
    track it was made from ("0" when that leaves nothing), copies `forced`, and
    copies `hearing_impaired` from image tracks. Companions that fell away are
    simply not in `companions`, so their track keeps its default."""
    flags = F.split(F.coalesce("flags", F.lit("")), r"\+")
    moved = companions.select(*key, "pos", F.lit(True).alias("_moved"))
    left = F.array_join(F.array_remove(flags, "default"), "+")
    source = F.when(F.col("_moved") & F.col("default"), F.when(left == "", "0").otherwise(left)).otherwise(F.col("flags"))
    own = F.array_compact(F.array(
        F.when(F.col("default"), "default"), F.when(F.col("forced"), "forced"),
        F.when(F.col("codec").isin(IMAGE_CODECS) & F.array_contains(flags, "hearing_impaired"), "hearing_impaired")))
    copy = F.array_join(own, "+")
    made = F.when(F.col("_moved"), F.struct(F.lit("companion").alias("kind"), F.when(copy == "", "0").otherwise(copy).alias("flags")))
    # one join gives a track and its companion; both sides grow with the library, so neither is collected for a broadcast
    both = kept.join(moved.hint("merge"), [*key, "pos"], "left")
    return both.select(*key, "pos", F.inline(F.array_compact(F.array(F.struct(F.lit("source").alias("kind"), source.alias("flags")), made))))


def lost_defaults(planned: DataFrame, companions: DataFrame, key: Sequence[str] = FILE) -> DataFrame:
    """Default streams whose planned companion is missing: they get the flag back."""
    return planned.filter("default").select(*key, "pos").join(companions.select(*key, "pos").hint("merge"), [*key, "pos"], "left_anti")


def zip_streams(subs: DataFrame, tracks: DataFrame, key: Sequence[str] = FILE) -> DataFrame:
    """Fill `empty` from a second tool's subtitle list (key, id, codec_id, entries), matched by order.

    All or nothing per file: a different number of tracks, a codec that cannot
    be the same one, or a tool that reports no entries leaves every stream as it was.
    """
    one = F.lit(1).cast("long")
    a = ordered_scan(subs.withColumn("_one", one), key, ["pos"], width=STREAMS, running={"_nth": ("sum", "_one")}, totals={"_na": ("sum", "_one")}).drop("_one")
    b = tracks.select(*key, "id", F.coalesce("codec_id", F.lit("")).alias("_id"), F.col("entries").alias("_entries"), one.alias("_there"))
    b = ordered_scan(b, key, ["id"], width=STREAMS, running={"_nth": ("sum", "_there")}, totals={"_nb": ("sum", "_there"), "_ne": ("count", "_entries")})
    allowed = F.create_map(*[x for c, ids in CODEC_IDS.items() for x in (F.lit(c), F.array(*[F.lit(i) for i in ids]))])
    ids = F.try_element_at(allowed, F.col("codec"))
    fits = F.col("_there").isNotNull() & (ids.isNull() | F.array_contains(ids, F.upper("_id")))
    # lists and files grow with the library: none is collected for a broadcast
    both = a.join(b.drop("id").hint("merge"), [*key, "_nth"], "left").withColumn("_fits", fits)
    told = both.join(both.groupBy(*key).agg(F.every("_fits").alias("_all")).hint("merge"), [*key], "left")
    # a file of as many tracks as streams has a track for each of them
    usable = F.coalesce((F.col("_na") == F.col("_nb")) & (F.col("_ne") > 0) & F.col("_all"), F.lit(False))
    fills = usable & F.col("empty").isNull() & F.col("_entries").isNotNull()
    return (told.withColumn("why", F.when(fills, F.concat(F.lit("entries="), F.col("_entries").cast("string"))).otherwise(F.col("why")))
            .withColumn("empty", F.when(fills, F.col("_entries") == 0).otherwise(F.col("empty")))
            .select(*subs.columns))


# --- cues ----------------------------------------------------------------------

def cue_intervals(events: DataFrame, key: Sequence[str] = TRACK) -> DataFrame:
    """Cues from display-set ends (seq, pts in 90 kHz ticks, kind compose / erase).

    The next end of either kind closes a cue; one left open, or closed at its own
    start, lasts the track's upper-median closed duration (2 s without any).
    """
    key = list(key)
    steps = ordered_scan(events, key, ["seq"], width=CUES, lead={"_end": "pts"})
    opened = settle(steps.filter(F.col("kind") == "compose").withColumn(
        "_lasts", F.when(F.col("_end") > F.col("pts"), F.col("_end") - F.col("pts"))))
    usual = exact_quantile(opened, key, "_lasts", {"_usual": 0.5}, "upper")
    cues = opened.join(usual, key, "left").withColumn(
        "_d", F.coalesce(F.col("_lasts").cast("double"), F.col("_usual"), F.lit(2.0 * TICKS)))
    cues = position(cues, key, ["seq"], CUES, "cue_idx")
    return cues.select(*key, "cue_idx", (F.col("pts") / TICKS).alias("start"),
                       ((F.col("pts") + F.col("_d")) / TICKS).alias("end"), F.col("_lasts").isNull().alias("unclosed"))


def orphan_erases(events: DataFrame, key: Sequence[str] = TRACK) -> DataFrame:
    """Erases with no cue open, per track."""
    steps = ordered_scan(events, key, ["seq"], width=CUES, lag={"_prev": "kind"})
    orphan = (F.col("kind") == "erase") & ~F.coalesce(F.col("_prev") == "compose", F.lit(False))
    return steps.groupBy(*key).agg(F.count_if(orphan).alias("orphans"))


def srt_blocks(cues: DataFrame, key: Sequence[str] = TRACK) -> DataFrame:
    """One row per cue that has text, numbered from 1, as its block of an .srt file."""
    numbered = position(cues.filter(F.coalesce("text", F.lit("")) != ""), key, ["cue_idx"], CUES, "_n")
    block = F.concat((F.col("_n") + 1).cast("string"), F.lit("\n"), srt_timestamp(F.col("start")), F.lit(" --> "),
                     srt_timestamp(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return numbered.select(*key, (F.col("_n") + 1).alias("n"), block.alias("block"))


TOKEN = r"[A-Za-z][A-Za-z'\-]*"
CLITIC = r"'(s|t|re|ll|ve|d|m|em)$"


def cue_words(cues: DataFrame, key: Sequence[str] = TRACK) -> DataFrame:
    """Words of each track with how often they occur, clitics cut off."""
    word = F.regexp_replace(F.regexp_replace(F.lower("token"), r"^['\-]+|['\-]+$", ""), CLITIC, "")
    tokens = cues.select(*key, F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token"))
    return tokens.groupBy(*key, word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


def track_signals(cues: DataFrame, lexicon: DataFrame, key: Sequence[str] = TRACK) -> DataFrame:
    """Quality signals of each track. `lexicon` has one `word` column."""
    key = list(key)
    told = cues.withColumn("_text", F.coalesce("text", F.lit("")))
    said = told.filter(F.col("_text") != "")
    steps = ordered_scan(said, key, ["cue_idx"], width=CUES, lead={"_next": "start"})
    chars = F.length("_text")
    bars = chars - F.length(F.replace("_text", F.lit("|"), F.lit("")))
    foreign = F.length(F.regexp_replace("_text", r"[\x00-\x7F]", ""))
    out = steps.groupBy(*key).agg(
        F.count(F.lit(1)).alias("srt_cues"),
        F.count_if(F.col("start") >= F.col("_next")).alias("_late"), F.count_if(F.col("end") - F.col("start") <= 0).alias("_bad"),
        F.count_if(F.col("end") > F.col("_next") + 1e-6).alias("overlaps"),
        F.sum(chars).cast("long").alias("chars_total"), F.sum(bars).cast("long").alias("bars"),
        F.sum(foreign).cast("long").alias("nonascii"))
    all_cues = told.groupBy(*key).agg(
        F.count(F.lit(1)).alias("pgs_cues"), F.count("rung").alias("_used"), F.count_if(F.col("rung") == "primary").alias("_first"))
    median = exact_quantile(said.withColumn("_chars", chars), key, "_chars", {"chars_per_cue": 0.5}, "upper")
    words = cue_words(said.select(*key, F.col("_text").alias("text")), key)
    known = lexicon.select("word").distinct().withColumn("_known", F.lit(True))
    judged = words.join(known, "word", "left").groupBy(*key).agg(
        F.sum("n").alias("tokens"),
        F.sum(F.when(F.col("_known").isNull() & (F.col("word") != ""), F.col("n")).otherwise(0)).alias("_oov"))
    entries = lexicon.agg(F.count_distinct("word")).scalar()
    t = all_cues.join(out, key, "left").join(median, key, "left").join(judged, key, "left").withColumn("lexicon_entries", entries)
    zero = [c for c in t.columns if c not in key]
    t = t.fillna(0, subset=zero)
    n, n_out, total = F.greatest("pgs_cues", F.lit(1)), F.greatest("srt_cues", F.lit(1)), F.greatest("chars_total", F.lit(1))
    return t.select(
        *key, "pgs_cues", "srt_cues", (F.col("pgs_cues") - F.col("srt_cues")).alias("empty_cues"),
        F.round(F.col("srt_cues") / n, 6).alias("cue_coverage"),
        F.round((F.col("pgs_cues") - F.col("srt_cues")) / n, 6).alias("empty_rate"),
        ((F.col("_late") == 0) & (F.col("_bad") == 0)).alias("timing_parse_sane"),
        "overlaps", F.round(F.col("overlaps") / n_out, 6).alias("overlap_rate"), "chars_total",
        F.col("chars_per_cue").cast("double").alias("chars_per_cue"), "bars",
        F.round(F.lit(1000.0) * F.col("bars") / total, 4).alias("bar_rate"),
        F.round(1.0 - F.col("_first") / F.greatest("_used", F.lit(1)), 6).alias("fallback_rate"),
        "nonascii", F.round(F.col("nonascii") / total, 6).alias("nonascii_rate"), "tokens",
        F.when(F.col("tokens") > 0, F.round(F.col("_oov") / F.col("tokens"), 6)).otherwise(0.0).alias("oov_rate"),
        "lexicon_entries")


def evaluate_gates(signals: DataFrame, gates: Sequence[tuple[str, str, float]] = GATES, min_tokens: int = MIN_TOKENS,
                   key: Sequence[str] = TRACK) -> DataFrame:
    """One row per (track, gate): pass, fail or skipped."""
    def gate(name: str, op: str, bound: float) -> Column:
        value = F.col(name).cast("double")
        ok = {"<=": value <= bound, ">=": value >= bound, "==": value == bound}[op]
        skip = F.lit(False)
        if name == "oov_rate":
            skip = (F.col("tokens") < min_tokens) | (F.col("lexicon_entries") == 0)
        result = F.when(skip, "skipped").when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
        return F.struct(F.lit(name).alias("gate"), value.alias("value"), F.lit(op).alias("op"),
                        F.lit(float(bound)).alias("bound"), result.alias("result"))

    return signals.select(*key, F.inline(F.array(*[gate(*g) for g in gates])))


def passed_tracks(gates: DataFrame, key: Sequence[str] = TRACK) -> DataFrame:
    return gates.groupBy(*key).agg(F.every(F.col("result") != "fail").alias("ok"), F.count_if(F.col("result") == "fail").alias("failed"))


# --- cue repair ----------------------------------------------------------------

INITIALISM = r"(?:[A-Za-z]{0,2}\.){3,}"
WELL_FORMED = r"^(?:[A-Z]\.){3,}$"
RUN = r"[\p{L}\p{N}|]+"


def track_gazetteer(cues: DataFrame, key: Sequence[str] = TRACK) -> DataFrame:
    """Dotted initialisms each track spells correctly somewhere (strokes and ones read as I), counted."""
    tokens = cues.select(*key, "cue_idx", F.posexplode(F.regexp_extract_all(
        F.translate(clean_text(F.col("text")), "|1", "II"), F.lit(INITIALISM), F.lit(0))).alias("_p", "_s"))
    good = tokens.filter(F.col("_s").rlike(WELL_FORMED))
    return good.groupBy(*key, F.replace("_s", F.lit("."), F.lit("")).alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("cue_idx", "_p")).alias("first_seen"))


def _weave(text: Column, pattern: str, pieces: Column) -> Column:
    """Text with its matches of `pattern` replaced by `pieces`, in order."""
    gaps = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(gaps, F.concat(pieces, F.array(F.lit(""))), lambda g, p: F.concat(g, p)), "")


def _leading_stroke(text: Column) -> Column:
    """Words that follow a stroke opening a run and are all lower case, where a
    stroke could be an l as well as an I (not after a dot)."""
    runs, gaps = F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), F.split(text, RUN, -1)
    rest = F.zip_with(runs, F.slice(gaps, 1, F.size(runs)), lambda r, g: F.when(
        r.rlike(r"^\|[^\p{Lu}\p{Lt}]*\p{Ll}[^\p{Lu}\p{Lt}]*$") & ~g.endswith("."), F.substr(r, F.lit(2))))
    return F.array_distinct(F.array_compact(rest))


def _strokes(text: Column, as_l: Column) -> Column:
    """Strokes read as l inside a lower-case word, or where `as_l` holds the word they open; else as I."""
    runs, gaps = F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), F.split(text, RUN, -1)

    def fixed(r: Column, g: Column) -> Column:
        low = F.regexp_extract(r, r"^([^\p{Lu}\p{Lt}]*)", 1)
        head = F.regexp_extract(low, r"^([^\p{Ll}]*)", 1)
        body = F.substr(low, F.length(head) + 1)
        tail = F.substr(r, F.length(low) + 1)
        opening = F.when(r.startswith("|") & F.array_contains(as_l, F.substr(r, F.lit(2))) & ~g.endswith("."),
                         F.concat(F.lit("l"), F.replace(F.substr(head, F.lit(2)), F.lit("|"), F.lit("I")))).otherwise(
            F.replace(head, F.lit("|"), F.lit("I")))
        return F.when(r.contains("|"), F.concat(
            opening, F.replace(body, F.lit("|"), F.lit("l")), F.replace(tail, F.lit("|"), F.lit("I")))).otherwise(r)

    return _weave(text, RUN, F.zip_with(runs, F.slice(gaps, 1, F.size(runs)), fixed))


def _initialism(s: Column) -> Column:
    """Parts of a dotted token: plain reading, the letters as a candidate, dots of
    an ellipsis, and whether it is one at all / already reads well."""
    body = F.regexp_replace(s, r"\.+$", "")
    core = F.split(body, r"\.")
    trail = F.length(s) - F.length(body)
    fixed = F.transform(core, lambda x: F.when(x.isin("l", "1"), F.lit("I")).otherwise(x))
    plain = F.array_join(F.transform(fixed, lambda x: F.concat(x, F.lit("."))), "")
    is_one = ((F.size(core) >= 3) & (F.length(F.regexp_replace(body, "[^A-Za-z]", "")) >= 2) & body.rlike("[A-Z]")
              & ~F.exists(core, lambda x: F.length(x) > 2))
    return F.struct(s.alias("s"), is_one.alias("is_one"), plain.alias("plain"),
                    F.upper(F.array_join(fixed, "")).alias("cand"),
                    F.repeat(F.lit("."), F.greatest(trail - 1, F.lit(0))).alias("extra"),
                    (is_one & ~plain.rlike(WELL_FORMED)).alias("damaged"))


def _deletions(word: Column) -> Column:
    """The word and everything left of it after dropping one or two characters.

    Two words within edit distance 2 share one of these, which turns the
    nearest-word search into an equality join.
    """
    def drop_one(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(
            F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))

    one = drop_one(word)
    return F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, drop_one))))


def _snaps(damaged: DataFrame, gazetteer: DataFrame, key: Sequence[str]) -> DataFrame:
    """The track's nearest well-spelled initialism of each damaged reading, within two edits."""
    words = damaged.select(*key, "cand").distinct()
    left = words.select(*key, "cand", F.explode(_deletions(F.col("cand"))).alias("_d"))
    right = gazetteer.select(*key, "word", "n", "first_seen", F.explode(_deletions(F.col("word"))).alias("_d"))
    near = (left.join(right, [*key, "_d"]).select(*key, "cand", "word", "n", "first_seen").distinct()
            .withColumn("_lev", F.levenshtein("cand", "word")).filter("_lev <= 2"))
    return near.groupBy(*key, "cand").agg(
        F.min_by("word", F.struct(F.col("_lev"), (-F.col("n")).alias("o"), F.col("first_seen"))).alias("snap"))


def clean_cues(cues: DataFrame, lexicon: DataFrame, key: Sequence[str] = TRACK) -> DataFrame:
    """Cue text after the recognition repairs, with the hits of each rule.

    Blanks, strokes read by context (and by the lexicon where a word could open
    with l or I), dash spacing, straight quotes, dotted initialisms snapped to
    the track's own spelling, and the missing dash of a two-speaker cue.
    The lexicon and the gazetteer are joined, never carried into a closure.
    """
    key = list(key)
    at = [*key, "cue_idx"]
    rows = cues.withColumn("_t", clean_text(F.coalesce("text", F.lit(""))))
    # words a stroke opens: l if the lexicon knows the word with l and not with i
    asked = rows.filter(F.col("_t").contains("|")).select(*at, F.explode(_leading_stroke(F.col("_t"))).alias("_w"))
    lex = lexicon.select("word").distinct()
    with_l = lex.filter(F.col("word").startswith("l")).select(F.substr("word", F.lit(2)).alias("_lw"))
    with_i = lex.filter(F.col("word").startswith("i")).select(F.substr("word", F.lit(2)).alias("_lw"))
    choice = (asked.withColumn("_lw", F.lower("_w")).join(with_l, "_lw", "left_semi").join(with_i, "_lw", "left_anti")
              .groupBy(*at).agg(F.collect_set("_w").alias("_as_l")))
    rows = rows.join(choice, at, "left").withColumn("_as_l", F.coalesce("_as_l", F.array().cast("array<string>")))
    rows = rows.withColumn("bar_to_I", F.length("_t") - F.length(F.replace("_t", F.lit("|"), F.lit(""))))
    rows = rows.withColumn("_t", F.when(F.col("bar_to_I") > 0, _strokes(F.col("_t"), F.col("_as_l"))).otherwise(F.col("_t")))
    rows = rows.withColumn("dash_space", F.regexp_count("_t", F.lit(r"(?m)^-(?=\S)")))
    rows = rows.withColumn("_t", F.regexp_replace("_t", r"(?m)^-(?=\S)", "- "))
    rows = rows.withColumn("smart_quotes", F.regexp_count("_t", F.lit("[‘’“”]")))
    rows = rows.withColumn("_t", F.translate("_t", "‘’“”", "''\"\""))

    rows = settle(rows.drop("_as_l").withColumn(
        "_ini", F.transform(F.regexp_extract_all("_t", F.lit(INITIALISM), F.lit(0)), _initialism)))
    hurt = rows.select(*at, F.explode(F.filter("_ini", lambda i: i["damaged"])).alias("_i")).select(*at, "_i.cand")
    snaps = _snaps(hurt, track_gazetteer(cues, key), key)
    per_cue = hurt.distinct().join(snaps, [*key, "cand"]).groupBy(*at).agg(
        F.map_from_entries(F.collect_list(F.struct("cand", "snap"))).alias("_snap"))
    rows = rows.join(per_cue, at, "left")

    def reading(i: Column) -> Column:
        snap = F.when(i["damaged"], F.try_element_at(F.col("_snap"), i["cand"]))
        dotted = F.array_join(F.transform(F.split(snap, ""), lambda c: F.concat(c, F.lit("."))), "")
        return F.when(~i["is_one"], i["s"]).otherwise(F.concat(F.coalesce(dotted, i["plain"]), i["extra"]))

    new = F.transform("_ini", reading)
    rows = rows.withColumn("_new", new).withColumn("dotted_acronym", F.size(F.filter(
        F.zip_with("_ini", "_new", lambda i, n: i["s"] != n), lambda x: x)))
    rows = rows.withColumn("_t", F.when(F.size("_ini") > 0, _weave(F.col("_t"), INITIALISM, F.col("_new"))).otherwise(F.col("_t")))

    lines = F.split("_t", "\n")
    first, second = F.element_at(lines, 1), F.try_element_at(lines, F.lit(2))
    dash1, dash2 = F.ltrim(first).startswith("-"), F.ltrim(second).startswith("-")
    pair = F.coalesce((F.size(lines) == 2) & (dash1 != dash2), F.lit(False))

    def dashed(line: Column) -> Column:
        bare = F.when(F.substr(line, F.lit(1), F.lit(1)).isin('"', "“", "”"), F.substr(line, F.lit(2))).otherwise(line)
        return F.concat(F.lit("- "), F.ltrim(bare))

    rows = rows.withColumn("pair_dash", pair.cast("int")).withColumn("_t", F.when(pair, F.when(
        dash1, F.concat_ws("\n", first, dashed(second))).otherwise(F.concat_ws("\n", dashed(first), second))).otherwise(F.col("_t")))
    rules = ["bar_to_I", "dash_space", "smart_quotes", "dotted_acronym", "pair_dash"]
    keep = [c for c in cues.columns if c != "text"]
    return rows.select(*keep, clean_text(F.col("_t")).alias("text"), *[F.col(r).cast("long").alias(r) for r in rules])


def rule_hits(cleaned: DataFrame, key: Sequence[str] = TRACK) -> DataFrame:
    rules = ["bar_to_I", "dash_space", "smart_quotes", "dotted_acronym", "pair_dash"]
    return cleaned.groupBy(*key).agg(*[F.sum(r).alias(r) for r in rules])


def recognise(cues: DataFrame, recognise_udf, image: str = "image") -> DataFrame:
    """Text of image cues by the caller's recogniser: a pandas UDF from binary to struct<text, rung>."""
    return cues.withColumn("_r", recognise_udf(F.col(image))).withColumn("text", F.col("_r.text")).withColumn(
        "rung", F.col("_r.rung")).drop("_r")
