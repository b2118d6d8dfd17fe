"""Line-first cleaning: rules judge each line, failing lines go, and a document that lost too much goes with them.

A line that holds a word fails, by the first rule that says so, if
  repeat       it equals an earlier line of the document
  punctuation  it has under SHORT words and no end mark, or more than one symbol of `#*$%&|<>` for two words
  navigation   it holds two separators of `|»›•·>` or more, one for three words at least, or up to MENU words, all of
               them of a menu
  boilerplate  it has up to NOTICE words and holds a phrase of a notice
Lines without a word stay. A document fails the base rules with under 20 words, or if over 30 % of its words lie in
8-word windows that occur twice; it is kept if it passes them and its failing lines hold at most half of its words.

One pass over each text in an Arrow batch; nothing is shuffled or collected, so a hot source or a group of copies costs
what its rows cost. Memory is linear in the longest text. NULL texts are empty ones (no words: not kept); repeated rows
get the same answer each; an empty table gives no rows; other columns stay as they are, a column named like the
result is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SHORT, MENU, NOTICE = 3, 6, 40
MOST_LOST = 50

# fixed values: marks that end a sentence, separators of menus, words of menus, phrases of notices
END_MARKS = ".!?:;…。！？।؟\"'”’»)]"
SEPARATORS = "|»›•·>"
MENU_WORDS = ("home menu login logout log in out sign up register search next previous prev back top contact us about help faq sitemap share tweet "
              "print email skip to content main navigation more read accueil recherche inicio buscar startseite suche kontakt contacto").split()
NOTICES = ("all rights reserved|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados|terms of use|terms of service|"
           "terms and conditions|privacy policy|cookie policy|accept cookies|enable javascript|javascript is disabled|copyright ©|copyright \\(c\\)|"
           "© [0-9]{4}|licensed under the|powered by|click here|subscribe to our|lorem ipsum")

SPACE = "\x20\t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")
NOTICE_OF = re.compile(NOTICES)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = ("repeat", "punctuation", "navigation", "boilerplate")

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "n_repeat_lines long, n_punctuation_lines long, n_navigation_lines long, n_boilerplate_lines long, n_lost_words long, kept boolean, text string")


def count_of(text: str, characters: str) -> int:
    return sum(map(text.count, characters))


def failing_rule(line: str, words: list[str]) -> str | None:
    """The first rule of a line alone that it fails."""
    n = len(words)
    if n < SHORT and words[-1][-1] not in END_MARKS or 2 * count_of(line, "#*$%&|<>") > n:
        return "punctuation"
    parted = count_of(line, SEPARATORS)
    if parted >= 2 and 3 * parted >= n:
        return "navigation"
    if n > NOTICE:
        return None
    low = line.translate(LOWER)
    if n <= MENU and all(w.strip(SEPARATORS + ".,:") in MENU_SET for w in WORD.findall(low)):
        return "navigation"
    return "boilerplate" if NOTICE_OF.search(low) else None


MENU_SET = {*MENU_WORDS, ""}


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found more than once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    # windows that occur once nearly always differ here already; the rest is compared word by word
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mark = np.zeros(n, np.uint64)
    for i in range(window):
        mark = mark * np.uint64(0xBF58476D1CE4E5B9) + mixed[i:i + n]
    order = np.sort(mark)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mark, twice))
    seen = np.lib.stride_tricks.sliding_window_view(ids, window)[at]
    _, same, times = np.unique(seen, axis=0, return_inverse=True, return_counts=True)
    step = np.zeros(len(words) + 1, np.int64)
    start = at[times[same.ravel()] > 1]
    step[start] += 1
    step[start + window] -= 1
    return int((np.cumsum(step) > 0).sum())


def judge(text: str | None) -> tuple:
    """The columns of RESULT for one text."""
    text = text or ""
    earlier, words, left = set(), [], []
    failed, repeats, lost = dict.fromkeys(RULES, 0), 0, 0
    for line in text.split("\n"):
        here = WORD.findall(line)
        if here:
            again = line in earlier
            earlier.add(line)
            repeats += again
            rule = "repeat" if again else failing_rule(line, here)
            words += here
            if rule:
                failed[rule] += 1
                lost += len(here)
                continue
        left.append(line)
    n, in_windows = len(words), repeated_words(words)
    base_failed = n < LEAST_WORDS or 100 * in_windows > MOST_REPEATED * n
    kept = not base_failed and 100 * lost <= MOST_LOST * n
    return (n, len(text) - count_of(text, SPACE), count_of(text, "#*$%&|<>"), repeats, in_windows, base_failed,
            *(failed[r] for r in RULES), lost, kept, "\n".join(left))


def judge_lines(docs: DataFrame, text: str = "text", name: str = "quality", texts: bool = True) -> DataFrame:
    """Add the struct `name` with the columns of RESULT; its `text` holds the lines that stay (NULL without `texts`)."""
    columns = [c.split()[0] for c in RESULT.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(':'.join(c.split()) for c in RESULT.split(', '))}>")
    def judged(batch: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([judge(t) for t in batch], columns=columns)
        return out if texts else out.assign(text=None)

    return docs.withColumn(name, judged(F.col(text)))


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their cleaned texts; other columns as they are."""
    judged = judge_lines(docs, text, "_quality").filter("_quality.kept")
    return judged.withColumn(text, F.col("_quality.text")).drop("_quality")


def _sql(text: str) -> str:
    return text.replace("'", "''")


_CLASS = "[" + END_MARKS.replace("]", "\\]") + "]$"
_TRIM = _sql("[" + SEPARATORS + ".,:]")
ORACLE = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS MATERIALIZED (SELECT rid, i, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs)),
facts AS (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS again, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
  len(regexp_extract_all(line, '[{SEPARATORS}]')) AS parted, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM lines WHERE len(w) > 0),
judged AS (SELECT rid, n, again, again OR (n < {SHORT} AND NOT regexp_matches(w[n], '{_sql(_CLASS)}')) OR 2 * symbols > n OR (parted >= 2 AND 3 * parted >= n)
  OR (n <= {MENU} AND len(list_filter(regexp_extract_all(low, '[^\\x20\\x09-\\x0D]+'), lambda x: NOT list_contains({["", *MENU_WORDS]}, regexp_replace(regexp_replace(x, '^{_TRIM}+', ''), '{_TRIM}+$', '')))) = 0)
  OR (n <= {NOTICE} AND regexp_matches(low, '{_sql(NOTICES)}')) AS fails FROM facts),
by_line AS (SELECT rid, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM judged GROUP BY rid),
words AS MATERIALIZED (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
wins AS MATERIALIZED (SELECT rid, p, w[p:p + {WINDOW - 1}] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM words)),
twice AS (SELECT rid, g FROM wins GROUP BY rid, g HAVING count(*) > 1),
inside AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest(range(p, p + {WINDOW})) AS q FROM wins JOIN twice USING (rid, g)) GROUP BY rid),
told AS (SELECT doc_id, len(w) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM docs JOIN words USING (rid) LEFT JOIN by_line USING (rid) LEFT JOIN inside USING (rid)),
base AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM told)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {MOST_LOST} * n_words AS kept,
       CAST(lost AS BIGINT) AS n_lost_words FROM base"""
