"""DuckDB SQL of the queries that SQL can express, from the definitions."""

from __future__ import annotations

import math

from .op4_quality import BOTH, CLASS_LIMIT, CLASSES, LACK_LIMIT, LETTER_GUARD, SHORT_SHARE, SYMBOLS, WORD_GUARD, WORD_LIMIT, WORDS

_WORD = r"[^\x20\x09-\x0D]+"


def _divergence(p: list[str], q: tuple[float, ...]) -> str:
    """Jensen-Shannon distance of shares given as SQL to constant ones."""
    terms = (f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y!r}) / 2)) ELSE 0 END + {y!r} * log2({y!r} / (({x} + {y!r}) / 2))" for x, y in zip(p, q, strict=True))
    return f"sqrt(greatest(0, ({' + '.join(terms)}) / 2))"


def quality_sql() -> str:
    count = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    classes = ("letters", "upper_case", "points", "n_symbols", "white")
    shares = ", ".join(f"CASE WHEN {' + '.join(classes)} > 0 THEN {c} / ({' + '.join(classes)})::DOUBLE ELSE 0 END AS share_{c}" for c in classes)
    listed = sorted({w for words in WORDS.values() for w in words})
    counted = ", ".join(f"len(list_filter(low, lambda x: x = '{w}')) / greatest(n_words, 1)::DOUBLE AS word_{w}" for w in listed)
    languages = []
    for words in WORDS.values():
        own, fixed = [f"word_{w}" for w in words], [v / 100 for v in words.values()]
        languages.append(_divergence([*own, f"greatest(0, 1 - ({' + '.join(own)}))"], (*fixed, 1 - math.fsum(fixed))))
    class_distance = f"least({', '.join(_divergence([f'share_{c}' for c in classes], q) for q in CLASSES.values())})"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents), "
        "p AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)), "
        "q AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, k) > 1), "
        "g AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM q), "
        "again AS (SELECT r, sum(n) AS n FROM g GROUP BY r), "
        "c AS (SELECT r, doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, "
        f"{count(SYMBOLS)} AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, {count('[0-9]')} AS digits, "
        rf"{count(r'\p{Lu}')} AS upper_case, {count(r'\p{P}')} - {count('[#*%&]')} AS points, {count('[A-Za-z]')} AS latin, list_transform(w, lambda x: lower(x)) AS low FROM d), "
        "e AS (SELECT *, greatest(word_chars - upper_case - digits - points - n_symbols, 0) AS letters, length(t) - word_chars AS white, len(lines) - len(list_distinct(lines)) AS n_dup_lines, "
        r"list_transform(list_filter(w, lambda x: regexp_full_match(x, '\p{L}{1,4}')), lambda x: lower(x)) AS short FROM c), "
        f"f AS (SELECT *, {shares}, {counted}, coalesce(again.n, 0) AS n_repeat_words FROM e LEFT JOIN again USING (r)), "
        f"s AS (SELECT *, {class_distance} AS class_distance, least({', '.join(languages)}) AS word_distance, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f) "
        "SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, "
        "CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed "
        f"AND NOT (word_chars >= {LETTER_GUARD} AND class_distance > {CLASS_LIMIT}) "
        f"AND NOT (n_words >= {WORD_GUARD} AND (word_distance > {WORD_LIMIT} OR (class_distance > {BOTH[0]} AND word_distance > {BOTH[1]}) "
        f"OR (word_distance > {LACK_LIMIT} AND len(short) - len(list_distinct(short)) < n_words * {SHORT_SHARE} AND latin * 2 > word_chars))) AS kept FROM s"
    )


ORACLE_SQL: dict[str, str] = {"op4_quality": quality_sql()}
