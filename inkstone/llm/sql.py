"""DuckDB SQL for the corpus queries that SQL expresses on whole tables. The other queries (1, 2, 4, 6, 7, 8, 12
and the pipeline) are held against brute force, round trips and held-out accuracy in tests/llm."""

from __future__ import annotations

from .centroids import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED
from .decontaminate import _EDGE, LEAST_PLAIN, LEAST_SHARE, UNITS, WINDOW
from .quality_rules import LEAST_WORDS, MOST_REPEATED, RULES, STOP_WORDS
from .quality_rules import WINDOW as REPEAT
from .secret_scan import BASE
from .secret_scan import RULES as SECRETS
from .source_audit import CAPITALS, LEAST_DOCS, SMALL, TOP, UNIT

BLANK = r"[\x20\x09-\x0D]+"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join(quote(w) for w in words)


def op3(limit: int) -> str:
    """Every prefix's bytes; a document's shard is its shortest prefix that fits."""
    return f"""
    with d as (select row_number() over () rid, doc_id, cast(coalesce(strlen(text), 0) as bigint) n_bytes, lpad(bin(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint)), 60, '0') bits from documents),
    p as (select *, unnest(range(0, 61)) depth from d), q as (select *, substr(bits, 1, depth) prefix from p),
    s as (select depth, prefix, sum(n_bytes) shard_bytes, count(*) shard_docs from q group by 1, 2),
    f as (select q.*, s.shard_bytes, s.shard_docs from q join s using (depth, prefix) where s.shard_bytes <= {limit} or depth = 60)
    select doc_id, n_bytes, prefix as shard, cast(depth as int) depth, cast(shard_bytes as bigint) shard_bytes, shard_docs, shard_bytes <= {limit} as fits from f
    qualify row_number() over (partition by rid order by depth) = 1"""


def op5() -> str:
    number = r"'^[+-]?[$€£]?[0-9][0-9.,:/]*$'"
    edge = quote(_EDGE)
    return rf"""
    with src as (select 'd' k, doc_id id, text from documents union all select 'b', item_id, text from benchmark),
    w as (select k, id, list_filter(string_split_regex(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') ws from src),
    t as (select k, id, unnest(range(1, len(ws) + 1)) i, unnest(ws) w from w),
    l as (select *, lag(w) over (partition by k, id order by i) before, trim(w, {edge}) bare, lower(trim(w, {edge})) low from t),
    m as (select *, case when regexp_matches(w, '[0-9]') and regexp_matches(bare, {number}) then '<num>' when low in ({listed(UNITS)}) and regexp_matches(before, '[0-9]') and regexp_matches(trim(before, {edge}), {number}) then '<unit>'
        when regexp_matches(w, '^["''(\[«“‘]?\p{{Lu}}') and not regexp_matches(before, '[.!?:…|]$') then '<name>' end kind from l),
    a as (select k, id, list(coalesce(kind, low) order by i) tw, list(case when kind is not null then low end order by i) tv from m group by 1, 2),
    x as (select k, id, tw, tv, unnest(range(1, len(tw) - {WINDOW} + 2)) pos from a),
    n as (select k, id, pos, array_to_string(tw[pos:pos + {WINDOW - 1}], ' ') h, tv[pos:pos + {WINDOW - 1}] slots from x where len(list_filter(tv[pos:pos + {WINDOW - 1}], lambda v: v is not null)) <= {WINDOW - LEAST_PLAIN}),
    sizes as (select id item_id, count(distinct pos) item_windows from n where k = 'b' group by 1),
    hits as (select distinct d.id doc_id, b.id item_id, b.pos item_pos, d.pos, b.slots item_slots, d.slots from n d join n b on d.h = b.h and d.k = 'd' and b.k = 'b'),
    pairs as (select doc_id, item_id, item_pos, pos, pos - item_pos as off, unnest(item_slots) a, unnest(slots) b from hits),
    votes as (select doc_id, item_id, off, a, b, count(*) c from pairs where a is not null group by 1, 2, 3, 4, 5),
    chosen as (select doc_id, item_id, off, a, b from votes qualify row_number() over (partition by doc_id, item_id, off, a order by c desc, b) = 1),
    bad as (select distinct p.doc_id, p.item_id, p.item_pos, p.pos from pairs p join chosen c on p.doc_id = c.doc_id and p.item_id = c.item_id and p.off = c.off and p.a = c.a where p.b <> c.b),
    good as (select h.*, pos - item_pos as off from hits h anti join bad using (doc_id, item_id, item_pos, pos)),
    counts as (select doc_id, item_id, count(distinct item_pos) n_windows from good group by 1, 2),
    slots as (select doc_id, item_id, count(distinct a) n_slots from chosen semi join good using (doc_id, item_id, off) group by 1, 2)
    select doc_id, item_id, n_windows, item_windows, coalesce(n_slots, 0) as n_slots from counts join sizes using (item_id) left join slots using (doc_id, item_id) where n_windows >= {LEAST_SHARE} * item_windows"""


def op9() -> str:
    ratio = lambda part, whole: f"case when {whole} > 0 then ({part}) / {whole} else 0.0 end"
    count = lambda array, test: f"len(list_filter({array}, lambda x: {test}))"
    edge = quote(".,;:!?\"'()")
    figures = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio(count("ws", f"lower(trim(x, {edge})) in ({listed(STOP_WORDS)})"), "n_words"),
        "alpha_word_ratio": ratio(count("ws", r"regexp_matches(x, '\p{L}')"), "n_words"),
        "capital_word_ratio": ratio(count("ws", "x = upper(x) and x <> lower(x) and length(x) > 1"), "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "len(ls)"),
        "bullet_line_ratio": ratio(count("ls", r"regexp_matches(x, '^[\x20\x09]*[-*•·‣]')"), "len(ls)"),
        "ellipsis_line_ratio": ratio(count("ls", r"regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$')"), "len(ls)"),
    }
    tests = []
    for rule in RULES:
        sides = [f"{rule.figure} < {rule.low}"] * (rule.low is not None) + [f"{rule.figure} > {rule.high}"] * (rule.high is not None)
        tests.append(f"case when {' or '.join(sides)} then '{rule.figure}' end")
    return rf"""
    with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
    w as (select *, list_filter(string_split_regex(t, '{BLANK}'), lambda x: x <> '') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
    g as (select rid, i, array_to_string(ws[i:i + {REPEAT - 1}], ' ') g from (select rid, ws, unnest(range(1, len(ws) - {REPEAT} + 2)) i from w)),
    twice as (select rid, i from g qualify count(*) over (partition by rid, g) > 1),
    r as (select rid, count(*) n from (select distinct rid, unnest(range(i, i + {REPEAT})) p from twice) group by 1),
    b as (select doc_id, ws, ls, cast(len(ws) as bigint) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) n_symbols,
        cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, cast(coalesce(r.n, 0) as bigint) n_repeat_words from w left join r using (rid)),
    f as (select *, {", ".join(f"{v} as {k}" for k, v in figures.items())}, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from b),
    v as (select *, list_filter([{", ".join(tests)}], lambda x: x is not null) broken from f)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(broken) = 0 as kept, array_to_string(broken, ',') as broken_rules from v"""


def op10() -> str:
    parts = []
    for order, rule in enumerate(SECRETS):
        p = quote(rule.pattern)
        parts.append(
            f"""select rid, {order} ord, '{rule.kind}' kind, s + before as start, s + before + length(m) as stop from (select rid, m, g, sum(length(piece)) over o s, coalesce(sum(length(m)) over (o rows between unbounded preceding and 1 preceding), 0) before from
            (select rid, unnest(range(1, len(ms) + 1)) i, unnest(ms) m, unnest(gs) g, unnest(pieces[1:len(ms)]) piece from (select rid, regexp_extract_all(t, {p}) ms, regexp_extract_all(t, {p}, {rule.group}) gs, string_split_regex(t, {p}) pieces from d))
            window o as (partition by rid order by i)) where length(g) >= {rule.least}"""
        )
    return f"""
    with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
    s as ({" union all ".join(parts)}),
    l as (select rid, {", ".join(f"count_if(kind = '{k}') n_{k}" for k in BASE)}, coalesce(string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, ord) filter (kind in ({listed(BASE)})), '') base,
        string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, ord) spans from s group by 1)
    select doc_id, {", ".join(f"cast(coalesce(n_{k}, 0) as bigint) n_{k}" for k in BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join l using (rid)"""


def op11() -> str:
    """Every source of a language against every term and every other source of it, without any shortcut."""
    share = lambda count, size: f"1 + ({UNIT} * ({count} + 1)::hugeint) // ({size} + v)"
    gain = "cast(((p - q) * (p - q)) // q as bigint)"
    return rf"""
    with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}') t from documents),
    w as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
    c as (select lang, source, term, count(*) n from w group by all),
    k as (select lang, term from w group by 1, 2 having count(distinct rid) >= {LEAST_DOCS}),
    v as (select lang, count(*) v from k group by 1),
    g as (select distinct lang, source from d),
    x as (select g.lang, g.source, k.term, coalesce(c.n, 0) n from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    y as (select x.*, v, sum(n) over (partition by lang, source) size, sum(n) over (partition by lang, term) n_all, sum(n) over (partition by lang) size_all from x join v using (lang)),
    z as (select lang, source, term, n, {share("n", "size")} p, {share("n_all", "size_all")} q from y),
    pairs as (select a.lang, a.source, b.source item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
        left join (select lang, source, item, sum({gain}) as value from (select a.lang, a.source, b.source item, a.p, b.p q from z a join z b on a.lang = b.lang and a.term = b.term and a.source <> b.source) group by 1, 2, 3) s on s.lang = a.lang and s.source = a.source and s.item = b.source),
    tops as (select lang, source, term item, {gain} as value from z where n > 0 and p > q),
    both_parts as (select lang, source, 'pair' part, item, cast(value as bigint) as value from pairs union all select lang, source, 'term', item, value from tops)
    select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) rank from both_parts qualify part = 'pair' or rank <= {TOP}"""


def op13() -> str:
    """Every round spelled out: distances to all centroids, the nearest one, and the mean of each cluster rounded down."""
    of = lambda c: f"list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (p.v[i] - {c}.v[i]) * (p.v[i] - {c}.v[i])))"
    nearest = lambda c: f"select vec_id, p.v, {c}.k, {of(c)} as distance from p, {c} qualify row_number() over (partition by vec_id order by distance, {c}.k) = 1"
    steps = [f"c0 as materialized (select row_number() over (order by h) - 1 k, v from (select v, sha256('{SEED}:' || vec_id) h from p order by h limit {CLUSTERS}))"]
    for i in range(ROUNDS):
        mean = "cast((s - ((s % n) + n) % n) // n as bigint)"
        steps.append(f"a{i} as materialized ({nearest(f'c{i}')})")
        steps.append(f"m{i} as materialized (select k, list({mean} order by i) v from (select k, i, cast(sum(x) as bigint) s, count(*) n from (select k, unnest(v) x, unnest(range(1, {DIMENSIONS + 1})) i from a{i}) group by 1, 2) group by 1)")
        steps.append(f"c{i + 1} as materialized (select c{i}.k, coalesce(m{i}.v, c{i}.v) v from c{i} left join m{i} using (k))")
    return f"""
    with p as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * {SCALE}) as bigint)) v from embeddings where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS}),
    {", ".join(steps)}, last as materialized ({nearest(f"c{ROUNDS}")})
    select vec_id, cast(last.k as int) as cluster, cast(distance as bigint) as distance, cast(sum(distance) over (partition by last.k) as bigint) cluster_inertia, cast(sum(distance) over () as bigint) inertia, sha256(array_to_string(c.v, ',')) centroid_sha256
    from last join c{ROUNDS} c on c.k = last.k"""


#: Bytes of text in a shard of the query. The tables at hand are small; 1 MiB lets the directory grow over several depths.
SHARD_BYTES = 1 << 20

ORACLES: dict[str, str] = {"op3_sharding": op3(SHARD_BYTES), "op5_decontamination": op5(), "op9_quality_rules": op9(), "op10_secret_scan": op10(), "op11_source_divergence": op11(), "op13_centroid_clustering": op13()}
