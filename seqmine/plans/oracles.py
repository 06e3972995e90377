"""DuckDB SQL from the definitions, not from the plans: what each query has to return."""

from __future__ import annotations

from .queries import MINING

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def _ordered(table: str, sid: str, item: str, order: str) -> str:
    return f"SELECT {sid} AS sid, row_number() OVER (PARTITION BY {sid} ORDER BY {order}) - 1 AS pos, {item} AS item FROM {table} WHERE {item} IS NOT NULL"


def _spread(table: str, sid: str) -> str:
    return f"SELECT sid, unnest(range(len(w))) AS pos, unnest(w) AS item FROM (SELECT {sid} AS sid, {_WORDS} AS w FROM {table})"


POSITIONS = {
    "events": _ordered("events", "user_id", "event_type", "ts, event_id, event_type"),
    "orders": _ordered("orders", "o_custkey", "o_orderpriority", "o_orderdate, o_orderkey, o_orderpriority"),
    "brands": _ordered(
        "(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)",
        "l_orderkey",
        "p_brand",
        "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus, p_brand",
    ),
    "documents": _spread("documents", "doc_id"),
    "turns": _spread("conversations", "conv_id * 1000000 + turn"),
}


def mining_sql(positions: str, sigma: int, gamma: int, lam: int, kind: str = "all") -> str:
    """Every way to extend a frequent prefix, counted once for each sequence of items."""
    levels = ["f1 AS (SELECT item, count(DISTINCT sid) AS support FROM p0 GROUP BY item HAVING count(DISTINCT sid) >= %d)" % sigma]
    levels.append("p AS (SELECT sid, pos, item FROM p0 WHERE item IN (SELECT item FROM f1))")
    levels.append("o1 AS (SELECT DISTINCT sid, pos AS e, [item] AS seq FROM p)")
    for k in range(2, lam + 1):
        levels.append(f"c{k} AS (SELECT DISTINCT o.sid, p.pos AS e, list_append(o.seq, p.item) AS seq FROM o{k - 1} o JOIN p ON p.sid = o.sid AND p.pos > o.e AND p.pos <= o.e + {gamma + 1})")
        levels.append(f"s{k} AS (SELECT seq, count(DISTINCT sid) AS support FROM c{k} GROUP BY seq HAVING count(DISTINCT sid) >= {sigma})")
        levels.append(f"o{k} AS (SELECT c.* FROM c{k} c JOIN s{k} USING (seq))")
    every = "SELECT [item] AS seq, support FROM f1" + "".join(f" UNION ALL SELECT seq, support FROM s{k}" for k in range(2, lam + 1))
    keep = "len(a.seq) >= 2"
    if kind != "all":
        same = " AND b.support = a.support" if kind == "closed" else ""
        part = "SELECT seq[1:len(seq)-1] AS seq, support FROM every WHERE len(seq) > 1 UNION ALL SELECT seq[2:len(seq)] AS seq, support FROM every WHERE len(seq) > 1"
        keep = f"NOT EXISTS (SELECT 1 FROM ({part}) b WHERE b.seq = a.seq{same})"
    return f"WITH p0 AS ({positions}), {', '.join(levels)}, every AS ({every}) SELECT array_to_string(a.seq, ' ') AS pattern, CAST(len(a.seq) AS INTEGER) AS length, CAST(a.support AS BIGINT) AS support FROM every a WHERE {keep}"


_DICTIONARY = "SELECT item, count(*) AS cf, count(DISTINCT sid) AS df, row_number() OVER (ORDER BY count(*) DESC, item) AS id FROM p0 GROUP BY item"


def _with_dictionary(positions: str, rest: str) -> str:
    return f"WITH RECURSIVE p0 AS ({positions}), dict AS ({_DICTIONARY}), {rest}"


def _parts(sigma: int, budget: int) -> str:
    return (
        f"f AS (SELECT row_number() OVER (ORDER BY id DESC) AS n, id, df FROM dict WHERE df >= {sigma}), "
        "walk AS (SELECT n, id, df AS total, 0 AS part FROM f WHERE n = 1 UNION ALL "
        f"SELECT f.n, f.id, CASE WHEN w.total + f.df > {budget} THEN f.df ELSE w.total + f.df END, CASE WHEN w.total + f.df > {budget} THEN w.part + 1 ELSE w.part END FROM walk w JOIN f ON f.n = w.n + 1), "
        "parts AS (SELECT CAST(part AS INTEGER) AS part, min(id) AS begin_item, max(id) AS end_item, CAST(max(total) AS BIGINT) AS total_df FROM walk GROUP BY part)"
    )


_EVENT_PARTS = _with_dictionary(POSITIONS["events"], _parts(10, 200) + ", enc AS (SELECT sid, pos, id AS item FROM p0 JOIN dict USING (item))")


def _rewrite(gamma: int, lam: int) -> str:
    reach = (gamma + 1) * (lam - 1)
    return (
        _EVENT_PARTS
        + ", touched AS (SELECT DISTINCT part, begin_item, end_item, sid FROM enc JOIN parts ON item BETWEEN begin_item AND end_item), "
        + "r AS (SELECT t.part, t.sid, e.pos, e.item, e.item >= t.begin_item AS is_pivot FROM touched t JOIN enc e ON e.sid = t.sid AND e.item <= t.end_item), "
        + f"g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY part, sid ORDER BY pos) - 1 > {gamma} THEN 1 ELSE 0 END AS cut FROM r), "
        + "s AS (SELECT *, sum(cut) OVER (PARTITION BY part, sid ORDER BY pos) AS seg FROM g) "
        + "SELECT a.part, a.sid, a.pos, a.item, CAST(a.is_pivot AS INTEGER) AS is_pivot FROM s a "
        + "WHERE (SELECT count(*) FROM s b WHERE b.part = a.part AND b.sid = a.sid AND b.seg = a.seg) >= 2 "
        + f"AND EXISTS (SELECT 1 FROM s b WHERE b.part = a.part AND b.sid = a.sid AND b.seg = a.seg AND b.is_pivot AND abs(b.pos - a.pos) <= {reach})"
    )


_TIMED = (
    "SELECT sid, CAST(start + r - 1 AS BIGINT) AS pos, item FROM (SELECT sid, t, item, row_number() OVER (PARTITION BY sid, t ORDER BY event_id, item) AS r FROM ev) JOIN "
    "(SELECT sid, t, coalesce(sum(step) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM "
    "(SELECT sid, t, greatest(count(*), lead(t) OVER (PARTITION BY sid ORDER BY t) - t) AS step FROM ev GROUP BY sid, t)) USING (sid, t)"
)
_TIMED = f"WITH ev AS (SELECT user_id AS sid, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, event_type AS item, event_id FROM events WHERE event_type IS NOT NULL) {_TIMED}"

_SEQUENCES = "SELECT sid, array_to_string(list(item ORDER BY pos), ' ') AS sequence FROM p0 GROUP BY sid"

ORACLES: dict[str, str] = {name: mining_sql(POSITIONS[source.__name__], sigma, gamma, lam, kind) for name, (source, sigma, gamma, lam, kind) in MINING.items()} | {
    "mine_pivot_events": mining_sql(POSITIONS["events"], 10, 1, 3),
    "mine_timed_events": mining_sql(_TIMED, 10, 24, 3),
    "mine_weighted_orders": mining_sql(POSITIONS["orders"], 10, 0, 3),
    "dictionary_documents": f"WITH p0 AS ({POSITIONS['documents']}) {_DICTIONARY}",
    "word_count_minsup": f"WITH p0 AS ({POSITIONS['documents']}) SELECT item, count(*) AS n FROM p0 GROUP BY item HAVING count(*) >= 50",
    "flist": f"WITH p0 AS ({POSITIONS['documents']}) SELECT * FROM ({_DICTIONARY}) WHERE df >= 20",
    "encode_documents": f"WITH p0 AS ({POSITIONS['documents']}), dict AS ({_DICTIONARY}) SELECT sid, CAST(pos AS BIGINT) AS pos, id AS item FROM p0 JOIN dict USING (item)",
    "translate_roundtrip": f"SELECT doc_id AS sid, md5(array_to_string({_WORDS}, ' ')) AS text_md5 FROM documents WHERE len({_WORDS}) > 0",
    "pivot_partitions": _with_dictionary(POSITIONS["documents"], _parts(20, 1000)) + " SELECT * FROM parts",
    "pivot_rewrite_events": _rewrite(0, 2),
    "pivot_offsets_events": _EVENT_PARTS + " SELECT part, sid, min(pos) AS first_pos, max(pos) AS last_pos FROM enc JOIN parts ON item BETWEEN begin_item AND end_item GROUP BY part, sid",
    "pivot_intervals_events": _EVENT_PARTS
    + ", q AS (SELECT DISTINCT part, sid, pos FROM enc JOIN parts ON item BETWEEN begin_item AND end_item), "
    + "g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY part, sid ORDER BY pos) > 4 THEN 1 ELSE 0 END AS cut FROM q), "
    + "s AS (SELECT *, sum(cut) OVER (PARTITION BY part, sid ORDER BY pos) AS seg FROM g) "
    + "SELECT part, sid, greatest(0, min(pos) - 2) AS start, max(pos) + 2 AS stop FROM s GROUP BY part, sid, seg",
    "weighted_dedup": f"WITH p0 AS ({POSITIONS['orders']}), q AS ({_SEQUENCES}) SELECT sequence, count(*) AS weight FROM q GROUP BY sequence",
    "total_support": "SELECT count(DISTINCT o_custkey) AS total FROM orders WHERE o_orderpriority IS NOT NULL",
    "stats_length": f"SELECT CAST(len({_WORDS}) AS BIGINT) AS length, count(*) AS n FROM documents WHERE len({_WORDS}) > 0 GROUP BY 1",
    "stats_distinct_items": f"SELECT CAST(len(list_distinct({_WORDS})) AS BIGINT) AS distinct_items, count(*) AS n FROM documents WHERE len({_WORDS}) > 0 GROUP BY 1",
    "max_pattern_by_item": f"WITH m AS ({mining_sql(POSITIONS['events'], 10, 1, 2)}) SELECT split_part(pattern, ' ', 1) AS item, max(support) AS support FROM m GROUP BY 1",
    "split_at_gap_segments": f"WITH p0 AS ({POSITIONS['documents']}), dict AS ({_DICTIONARY}), f AS (SELECT sid, pos FROM p0 JOIN dict USING (item) WHERE df >= 20), "
    + "g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY sid ORDER BY pos) - 1 > 1 THEN 1 ELSE 0 END AS cut FROM f), "
    + "s AS (SELECT *, sum(cut) OVER (PARTITION BY sid ORDER BY pos) AS segment FROM g) "
    + "SELECT sid, CAST(segment AS BIGINT) AS segment, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM s GROUP BY sid, segment",
    "posting_list": f"WITH p0 AS ({POSITIONS['orders']}), q AS (SELECT DISTINCT a.sid, a.pos AS start, a.item || ' ' || b.item AS pattern FROM p0 a JOIN p0 b ON a.sid = b.sid AND b.pos = a.pos + 1), "
    + "f AS (SELECT pattern, count(DISTINCT sid) AS support FROM q GROUP BY pattern HAVING count(DISTINCT sid) >= 10) SELECT pattern, support, sid, CAST(start AS BIGINT) AS start FROM q JOIN f USING (pattern)",
}

_EVENT_SEQUENCES = f"WITH p0 AS ({POSITIONS['events']}), q AS ({_SEQUENCES})"
_CODED = f"WITH p0 AS ({POSITIONS['events']}), dict AS ({_DICTIONARY}), q AS (SELECT sid, list(id ORDER BY pos) AS a FROM p0 JOIN dict USING (item) GROUP BY sid)"
_TEXT = "'[' || array_to_string({}, ', ') || ']'"
_REWRITTEN = f"SELECT part, sid, array_to_string(list(item ORDER BY pos), ' ') AS sequence FROM ({_rewrite(0, 2)}) GROUP BY part, sid"
_DELTAS = "list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = 1 THEN a[1] ELSE a[i] - a[i - 1] END)"

ORACLES |= {
    "read_text_sequences": f"{_EVENT_SEQUENCES} SELECT CAST(sid AS VARCHAR) AS seq_id, sequence FROM q",
    "read_numeric_ids": f"{_EVENT_SEQUENCES} SELECT CAST(sid AS BIGINT) AS seq_id, sequence FROM q",
    "read_separated_sequences": f"WITH p0 AS ({POSITIONS['orders']}), q AS ({_SEQUENCES}) SELECT CAST(sid AS VARCHAR) AS seq_id, sequence FROM q",
    "read_sentence_lines": f"SELECT array_to_string({_WORDS}, ' ') AS sequence, count(*) AS n FROM conversations WHERE len({_WORDS}) > 0 GROUP BY 1",
    "read_first_sentences": f"SELECT array_to_string({_WORDS}, ' ') AS sequence FROM conversations WHERE len({_WORDS}) > 0 ORDER BY conv_id, turn LIMIT 10",
    "read_length_prefixed_sequences": f"{_EVENT_SEQUENCES} SELECT CAST(sid AS BIGINT) AS seq_id, sequence FROM q",
    "mine_timed_text": mining_sql(_TIMED, 10, 24, 3),
    "read_integers_with_gaps": "SELECT CAST(before + gaps AS BIGINT) AS pos, CAST(ascii(event_type) AS BIGINT) AS item, count(*) AS n FROM (SELECT event_type, "
    "row_number() OVER w - 1 AS before, sum(event_id % 3) OVER w AS gaps FROM events WHERE event_type IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id, event_type)) GROUP BY 1, 2",
    "read_encoded_lines": f"{_CODED} SELECT CAST(sid AS VARCHAR) AS seq_id, array_to_string(a, ' ') AS sequence FROM q",
    "dictionary_file": f"WITH p0 AS ({POSITIONS['documents']}) SELECT item, df, id FROM ({_DICTIONARY}) WHERE df >= 5 AND cf >= 10",
    "dictionary_sorted_file": "SELECT * FROM (SELECT item, lag(item) OVER (ORDER BY item) AS before FROM (SELECT DISTINCT event_type AS item FROM events WHERE event_type IS NOT NULL)) WHERE before IS NOT NULL",
    "dictionary_lookup": f"WITH p0 AS ({POSITIONS['events']}) SELECT * FROM ({_DICTIONARY}) WHERE id = 1 OR item = 'click'",
    "encoded_file": f"SELECT sid, CAST(pos AS BIGINT) AS pos, item AS name FROM ({POSITIONS['events']})",
    "pattern_lines": f"SELECT pattern, support FROM ({mining_sql(POSITIONS['events'], 10, 1, 3)})",
    "pattern_file": mining_sql(POSITIONS["events"], 10, 1, 3),
    "resumed_run": f"SELECT pattern, support FROM ({mining_sql(POSITIONS['events'], 10, 1, 3, 'closed')})",
    "mine_each_file": " UNION ALL ".join(
        f"SELECT 'users{k}' AS users, pattern, support FROM ({mining_sql('SELECT * FROM (' + POSITIONS['events'] + f') WHERE sid % 2 = {k}', 5, 1, 3, 'maximal')})" for k in (0, 1)
    ),
    "pivot_sequences_events": _REWRITTEN,
    "pivot_one_partition_events": f"SELECT * FROM ({_REWRITTEN}) WHERE part = 0",
    "array_functions": f"{_CODED} SELECT a.sid, CAST(coalesce(list_position(list_transform(range(1, least(len(a.a), len(b.a)) + 1), lambda i: a.a[i] = b.a[i]), false) - 1, least(len(a.a), len(b.a))) AS BIGINT) AS prefix, "
    + f"{_TEXT.format('a.a')} AS said, {_TEXT.format(_DELTAS.replace('len(a)', 'len(a.a)').replace('a[', 'a.a['))} AS deltas, true AS decoded, list_max(a.a) AS pivot, "
    + "len(list_filter(a.a, lambda x: x BETWEEN 3 AND 4)) > 0 AS rare, CAST(len(a.a) * 4294967296 + len(b.a) AS BIGINT) AS pair, CAST(len(a.a) + len(b.a) AS BIGINT) AS pair_sum, "
    + "len(a.a) < len(b.a) OR (len(a.a) = len(b.a) AND a.a < b.a) AS before_other, CAST(CASE WHEN a.a = b.a THEN 1 ELSE 2 END AS BIGINT) AS segments, a.a = b.a AS same_hash, "
    + "CAST(2 * least(2, len(a.a)) AS BIGINT) AS n_ends FROM q a JOIN q b ON b.sid = a.sid + 1",
    "array_orders": f"{_CODED} SELECT sid, row_number() OVER (PARTITION BY a[1] ORDER BY a DESC, sid) AS descending, row_number() OVER (PARTITION BY a[1] ORDER BY a, sid) AS ascending, "
    + f"row_number() OVER (PARTITION BY a[1] ORDER BY len(a), a, sid) AS by_length, {_TEXT.format('a[1:2]')} AS first_two, {_TEXT.format('a[1:len(a) - 1]')} AS all_but_last, {_TEXT.format('a')} AS complete FROM q",
    "gap_lengths": f"WITH p0 AS ({POSITIONS['documents']}), dict AS ({_DICTIONARY}), f AS (SELECT sid, pos FROM p0 JOIN dict USING (item) WHERE df >= 20), "
    + "g AS (SELECT pos - lag(pos) OVER (PARTITION BY sid ORDER BY pos) - 1 AS gap FROM f) SELECT CAST(gap AS BIGINT) AS gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap",
}
