"""Queries of the metrics, bootstraps and plug-ins."""

from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import plugins
from ..operators.metrics import bootstrap, labels, overlap, similarity
from ..sources.sinks import work_folder
from .registry import d_squeeze, d_strip, query, r6
from .sampling_queries import _TOK, rounded
from .text_queries import d_sentences
from .views import Data, hash60

# -- word overlap --------------------------------------------------------------------------

_BTOK = "list_filter(string_split(" + d_squeeze("{0}") + ", ' '), lambda x: x <> '')"


def d_grams(tokens: str, orders) -> str:
    """Per pair and order: clipped matches, and the token counts."""
    grams = " union all ".join(
        f"select pair_id, {n} as n, {side} as side, array_to_string(list_slice(t, i, i + {n} - 1), ' ') as g from "
        f"(select pair_id, {side}t as t, unnest(range(1, len({side}t) - {n} + 2)) as i from tok) x"
        for n in orders
        for side in ("h", "r")
    ).replace("h as side", "'h' as side").replace("r as side", "'r' as side")
    return f"""tok as (select pair_id, {tokens.replace('{0}', 'hyp')} as ht, {tokens.replace('{0}', 'ref')} as rt from v_pairs),
    gr as ({grams}),
    hit as (select pair_id, n, sum(least(a, b)) as m from (select pair_id, n, g, count(case when side = 'h' then 1 end) as a, count(case when side = 'r' then 1 end) as b from gr group by 1, 2, 3) y group by 1, 2),
    cnt as (select tok.pair_id, len(ht) as hl, len(rt) as rl, """ + ", ".join(
        f"coalesce((select m from hit where hit.pair_id = tok.pair_id and n = {n}), 0) as m{n}" for n in orders
    ) + " from tok)"


def d_bleu(n):
    logs = " + ".join(f"ln(m{k} / d{k})" for k in range(1, n + 1))
    return f"round(case when least({', '.join(f'm{k}' for k in range(1, n + 1))}, 1e9) = 0 then 0 else case when hl > rl then 1 else exp(1 - rl / hl) end * exp(({logs}) / {n}) end, 6) as bleu_{n}"


_D = ", ".join(f"greatest(hl - {k} + 1, 0) as d{k}" for k in range(1, 5))
_DS = ", ".join(f"sum(greatest(hl - {k} + 1, 0)) as d{k}" for k in range(1, 5))


def nudged(df, *cols):
    """Rounded away from ties, which the two engines could break differently."""
    return df.withColumns({c: r6(F.col(c) + 1e-9) for c in cols})


def pairs(d: Data):
    return d.view("v_pairs")


@query("i1_bleu", f"with {d_grams(_BTOK, (1, 2, 3, 4))} select pair_id, {', '.join(d_bleu(n) for n in range(1, 5))} from (select *, {_D} from cnt) c")
def i1(d: Data):
    return rounded(overlap.bleu(pairs(d)), *[f"bleu_{n}" for n in range(1, 5)])


@query(
    "i1_corpus_bleu",
    f"with {d_grams(_BTOK, (1, 2, 3, 4))} select {', '.join(d_bleu(n) for n in range(1, 5))} from (select sum(hl) as hl, sum(rl) as rl, sum(m1) as m1, sum(m2) as m2, sum(m3) as m3, sum(m4) as m4, {_DS} from cnt) c",
)
def i1_corpus(d: Data):
    return rounded(overlap.corpus_bleu(pairs(d)), *[f"bleu_{n}" for n in range(1, 5)])


def d_rouge(n):
    h, r = f"greatest(hl - {n} + 1, 0)", f"greatest(rl - {n} + 1, 0)"
    return f"round(case when {h} + {r} = 0 then 0 else 2 * m{n} / ({h} + {r}) end + 1e-9, 6) as rouge_{n}"


@query("i2_rouge_n", f"with {d_grams(_TOK, (1, 2))} select pair_id, {d_rouge(1)}, {d_rouge(2)} from cnt")
def i2(d: Data):
    return nudged(overlap.rouge_n(pairs(d)), "rouge_1", "rouge_2")


def d_cells(lists: str) -> str:
    """cells(u, i, j, v) for <lists>(u, h, r): v is the longest common subsequence of the first i words of r and the first j of h."""
    return f"""cells as (
        select u, 0::bigint as i, j, 0::bigint as v from {lists}, unnest(range(len(h) + 1)) as x(j)
        union all
        select u, i + 1, j, max(best) over (partition by u order by j) from (
          select c.u, i, j, greatest(v, case when j > 0 and h[j] = r[i + 1] then lag(v) over (partition by c.u order by j) + 1 else 0 end) as best
          from cells c join {lists} l on c.u = l.u where i < len(r)) y)"""


@query(
    "i3_rouge_l",
    f"""with recursive l as (select pair_id as u, {_TOK.replace('{0}', 'hyp')} as h, {_TOK.replace('{0}', 'ref')} as r from v_pairs), {d_cells("l")}
        select u as pair_id, round(coalesce(2 * v / nullif(len(h) + len(r), 0), 0) + 1e-9, 6) as rouge_l from l join cells using (u) where i = len(r) and j = len(h)""",
)
def i3(d: Data):
    return nudged(overlap.rouge_l(pairs(d)), "rouge_l")


# From the last cell of every two sentences back: equal words are taken, else along h if v is greater there, else along r.
_LSUM = f"""with recursive s as (select pair_id, {d_sentences('hyp')} as hs, {d_sentences('ref')} as rs from v_pairs),
  hw as (select pair_id, k, {_TOK.replace('{0}', 'hs[k]')} as h from s, unnest(range(1, len(hs) + 1)) as x(k)),
  rw as (select pair_id, k, {_TOK.replace('{0}', 'rs[k]')} as r from s, unnest(range(1, len(rs) + 1)) as x(k)),
  l as (select {{p: hw.pair_id, a: hw.k, b: rw.k}} as u, h, r from hw join rw using (pair_id) where len(h) > 0 and len(r) > 0), {d_cells("l")},
  way as (
    select u, len(r)::bigint as i, len(h)::bigint as j, false as took from l
    union all
    select w.u, case when equal or not along then w.i - 1 else w.i end, case when equal or along then w.j - 1 else w.j end, equal from (
      select w.u, w.i, w.j, h[w.j] = r[w.i] as equal, a.v > b.v as along from way w join l on w.u = l.u
      join cells a on a.u = w.u and a.i = w.i and a.j = w.j - 1 join cells b on b.u = w.u and b.i = w.i - 1 and b.j = w.j where w.i > 0 and w.j > 0) w),
  taken as (select distinct u.p as pair_id, u.b as k, i from way where took),
  words as (select t.pair_id, r[i + 1] as w, count(*) as n from taken t join rw on t.pair_id = rw.pair_id and t.k = rw.k group by 1, 2),
  have as (select pair_id, w, count(*) as n from (select pair_id, unnest(h) as w from hw) y group by 1, 2),
  hits as (select pair_id, sum(least(words.n, have.n)) as m from words join have using (pair_id, w) group by 1),
  size as (select pair_id, coalesce((select sum(len(h)) from hw where hw.pair_id = s.pair_id), 0) as nh, coalesce((select sum(len(r)) from rw where rw.pair_id = s.pair_id), 0) as nr from s)
  select pair_id, round(coalesce(2 * m / nullif(nh + nr, 0), 0) + 1e-9, 6) as rouge_lsum from size left join hits using (pair_id)"""


@query("i4_rouge_lsum", _LSUM)
def i4(d: Data):
    return nudged(overlap.rouge_lsum(pairs(d)), "rouge_lsum")


# -- labels ------------------------------------------------------------------------------------

NAMES = list(vocab.REPORT_LABELS.values())
_SENT = f"(select doc_id, unnest(case when len(s) = 0 then [null] else s end) as s from (select doc_id, {d_sentences('text')} as s from documents) a)"


@query(
    "i5_merge_labels",
    "select doc_id, "
    + ", ".join(f"coalesce(max((length(s) % {i + 11} = 0)::int), 0) as {c}" for i, c in enumerate(NAMES[:-1]))
    + f", coalesce(min((length(s) % 17 = 0)::int), 1) as NF from {_SENT} b group by 1",
)
def i5(d: Data):
    rows = d.table("documents").select("doc_id", F.explode_outer(text.sentences("text")).alias("s"))
    n = F.length("s")
    cols = [F.when(n.isNotNull(), (n % (i + 11) == 0).cast("int")).alias(c) for i, c in enumerate(NAMES[:-1])]
    rows = rows.select("doc_id", *cols, F.when(n.isNotNull(), (n % 17 == 0).cast("int")).alias("NF"))
    return labels.merge_labels(rows, "doc_id", NAMES, "NF")


@query(
    "i6_map_class",
    """select event_id, case when event_id % 5 in (1, 3) then 1 else 0 end as rrg, case event_id % 5 when 1 then 1 when 2 then 0 when 3 then -1 end as tristate from events""",
)
def i6(d: Data):
    c = F.col("event_id") % 5
    return d.table("events").select("event_id", labels.map_class(c, "binary").alias("rrg"), labels.map_class(c, "tristate").alias("tristate"))


@query(
    "i7_label_accuracy",
    "select null as doc_id, round(avg((y_true = y_pred)::int), 6) as accuracy from v_labels union all select doc_id, round(avg((y_true = y_pred)::int), 6) from v_labels group by 1",
)
def i7(d: Data):
    overall, each = labels.label_accuracy(d.view("v_labels"), "doc_id")
    return rounded(overall.select(F.lit(None).cast("bigint").alias("doc_id"), "accuracy").unionByName(each), "accuracy")


def d_scores(by):
    return f"""select {by} as g, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, tp + fn as support from
    (select {by}, count(case when y_true = 1 and y_pred = 1 then 1 end) as tp, count(case when y_true <> 1 and y_pred = 1 then 1 end) as fp, count(case when y_true = 1 and y_pred <> 1 then 1 end) as fn from v_labels group by 1) c"""


@query(
    "i8_classification_report",
    f"""with c as ({d_scores('class')}), s as ({d_scores('doc_id')}), m as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from c),
        r as (select g as label, precision, recall, f1, support from c
          union all select 'micro avg', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn from m
          union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from c
          union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from c
          union all select 'samples avg', avg(precision), avg(recall), avg(f1), sum(support) from s)
        select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from r""",
)
def i8(d: Data):
    return rounded(labels.classification_report(d.view("v_labels"), "doc_id"), "precision", "recall", "f1")


# -- set similarity -------------------------------------------------------------------------------

_SIM = """(select h.pair_id, h.item_id as h, r.item_id as r, h.item_type as ht, r.item_type as rt, list_cosine_similarity(h.embedding::double[], r.embedding::double[]) as s
  from v_sets h join v_sets r on h.pair_id = r.pair_id where h.side = 'hyp' and r.side = 'ref')"""


@query(
    "i9_max_mean_cosine",
    f"""with s as {_SIM}, rm as (select pair_id, avg(m) as a from (select pair_id, h, max(s) as m from s group by 1, 2) x group by 1), cm as (select pair_id, avg(m) as b from (select pair_id, r, max(s) as m from s group by 1, 2) x group by 1)
        select p.pair_id, round(coalesce((a + b) / 2, 0), 6) as similarity from (select distinct pair_id from v_sets) p left join rm using (pair_id) left join cm using (pair_id)""",
)
def i9(d: Data):
    items = d.view("v_sets")
    return rounded(similarity.max_mean_cosine(items, items.select("pair_id")), "similarity")


@query(
    "i20_similarity_cells",
    f"""with s as {_SIM}, f as (select *, s = max(s) over (partition by pair_id, h) as row_max, s = max(s) over (partition by pair_id, r) as col_max from s)
        select pair_id, h as hyp_item, r as ref_item, round(s, 6) as similarity, row_max, col_max from f where row_max or col_max""",
)
def i20(d: Data):
    return rounded(similarity.similarity_cells(d.view("v_sets")), "similarity")


AFFINITY = {(f"T{a}", f"T{b}"): 0.25 + 0.05 * ((a * 3 + b) % 10) for a in range(10) for b in range(10) if a != b}


@query(
    "i13_entity_affinity_f1",
    f"""with s as (select *, s * case when ht = rt then 1 else cast(0.25 as double) + cast(0.05 as double) * ((substr(ht, 2)::int * 3 + substr(rt, 2)::int) % 10) end as w from {_SIM} z),
        rm as (select pair_id, avg(m) as a from (select pair_id, h, max(w) as m from s group by 1, 2) x group by 1), cm as (select pair_id, avg(m) as b from (select pair_id, r, max(w) as m from s group by 1, 2) x group by 1)
        select p.pair_id, round(coalesce(a, 0), 6) as precision, round(coalesce(b, 0), 6) as recall, round(case when n = 1 then 0 else coalesce(2 * a * b / nullif(a + b, 0), 0) end, 6) as f1
        from (select pair_id, count(distinct side) as n from v_sets group by 1) p left join rm using (pair_id) left join cm using (pair_id)""",
)
def i13(d: Data):
    items = d.view("v_sets")
    return rounded(similarity.entity_affinity_f1(items, items.select("pair_id"), AFFINITY), "precision", "recall", "f1")


def d_reward(kind, cols):
    return f"""select pair_id, '{kind}' as kind, 2 * count(case when h = 1 and r = 1 then 1 end) / (sum(h) + sum(r)) as f from
    (select pair_id, {cols}, max((side = 'hyp')::int) as h, max((side = 'ref')::int) as r from v_entities group by all) t group by 1"""


@query(
    "i12_entity_rewards",
    f"""with a as ({d_reward('simple', 'tokens, label')} union all {d_reward('partial', 'tokens, label, relation is null')} union all {d_reward('complete', 'tokens, label, relation, target_tokens')})
        select pair_id, round(max(f) filter (kind = 'simple'), 6) as simple, round(max(f) filter (kind = 'partial'), 6) as partial, round(max(f) filter (kind = 'complete'), 6) as complete from a group by 1""",
)
def i12(d: Data):
    e = d.view("v_entities")
    return rounded(similarity.entity_rewards(e, e.select("pair_id")), "simple", "partial", "complete")


# Facts of a sentence by its length: two, none (the sentence itself) or not listed.
@query(
    "i10_report_facts",
    f"""with s as (select doc_id, generate_subscripts(s, 1) - 1 as no, unnest(s) as s from (select doc_id, {d_sentences('text')} as s from documents) a where len(s) > 0),
        f as (select doc_id, no, unnest(case when length(s) % 3 = 0 then [0, 1] else [0] end) as fno, s from s where length(s) % 3 = 0 or regexp_matches(s, '\\p{{L}}')),
        g as (select doc_id, no, fno, case when length(s) % 3 <> 0 then s when fno = 0 then 'size ' || (length(s) % 20)::varchar else 'start ' || substr(s, 1, 2) end as fact from f)
        select doc_id, no::int as sentence_no, fno as fact_no, md5(fact) as digest from (select *, row_number() over (partition by doc_id, fact order by no, fno) as rn from g) z where rn = 1""",
)
def i10(d: Data):
    rows = d.table("documents").select(F.col("doc_id").alias("report_id"), F.posexplode(text.sentences("text")).alias("sentence_no", "sentence"))
    n = F.length("sentence")
    facts = rows.select("sentence").distinct().where(n % 3 != 1).select(
        "sentence",
        F.when(n % 3 == 0, F.array(F.concat(F.lit("size "), (n % 20).cast("string")), F.concat(F.lit("start "), F.substring("sentence", 1, 2)))).otherwise(F.array().cast("array<string>")).alias("facts"),
    )
    found = similarity.report_facts(rows, facts)
    return found.select(F.col("report_id").alias("doc_id"), "sentence_no", "fact_no", F.md5("fact").alias("digest"))


LETTERS = "aeinorst"


_VEC = "[" + ", ".join(f"(length(f) - length(replace(f, '{c}', '')) + 1)::double" for c in LETTERS) + "]"


@query(
    "i11_fact_score",
    f"""with t as (select pair_id, 'h' as side, hyp as t from v_pairs union all select pair_id, 'r', ref from v_pairs),
        s as (select pair_id, side, unnest({d_sentences('t')}) as s from t),
        f as (select distinct pair_id, side, {d_strip('p')} as f from (select pair_id, side, unnest(string_split(s, ',')) as p from s) x where {d_strip('p')} <> ''),
        v as (select pair_id, side, f, {_VEC} as v from f),
        m as (select h.pair_id, h.f as hf, r.f as rf, list_cosine_similarity(h.v, r.v) as s from v h join v r on h.pair_id = r.pair_id where h.side = 'h' and r.side = 'r'),
        rm as (select pair_id, avg(x) as a from (select pair_id, hf, max(s) as x from m group by 1, 2) y group by 1), cm as (select pair_id, avg(x) as b from (select pair_id, rf, max(s) as x from m group by 1, 2) y group by 1)
        select p.pair_id, round(coalesce((a + b) / 2, 0), 6) as similarity from v_pairs p left join rm using (pair_id) left join cm using (pair_id)""",
)
def i11(d: Data):
    # Stand-ins for the models: facts are the parts between commas, vectors count letters.
    extractor = plugins.text_model(lambda texts: [([p.strip() for p in t.split(",") if p.strip()],) for t in texts], "facts array<string>")
    encoder = plugins.text_model(lambda texts: [([float(t.count(c) + 1) for c in "aeinorst"],) for t in texts], "embedding array<double>")
    return rounded(similarity.fact_score(pairs(d), extractor, encoder), "similarity")


# -- registry ----------------------------------------------------------------------------------------

@query(
    "i14_compute_metrics",
    f"with {d_grams(_BTOK, (1, 2))}, b as (select pair_id, {d_bleu(1)}, {d_bleu(2)} from (select *, {_D.split(', greatest(hl - 3')[0]} from cnt) c) select b.*, (hyp = ref)::int::double as exact from b join v_pairs using (pair_id)",
)
def i14(d: Data):
    plugins.register_metric("exact", lambda p: p.select("pair_id", (F.col("hyp") == F.col("ref")).cast("double").alias("exact")))
    return rounded(plugins.compute_metrics(pairs(d), ["BLEU-1", "BLEU-2", "exact"]), "bleu_1", "bleu_2")


@query("i15_drop_empty_refs", f"select conv_id, count(*) as n from (select conv_id, case when length(ref) % 4 = 0 then ' ' || chr(10) else ref end as ref from v_pairs) a where {d_strip('ref')} <> '' group by 1")
def i15(d: Data):
    rows = pairs(d).withColumn("ref", F.when(F.length("ref") % 4 == 0, " \n").otherwise(F.col("ref")))
    return plugins.drop_empty_refs(rows).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("i21_summary", f"with {d_grams(_TOK, (1, 2))} select round(avg(rouge_1), 5) as rouge_1, round(avg(rouge_2), 5) as rouge_2 from (select {d_rouge(1)}, {d_rouge(2)} from cnt) r")
def i21(d: Data):
    means = plugins.summarize(nudged(plugins.compute_metrics(pairs(d), {"ROUGE-1": None, "ROUGE-2": None}), "rouge_1", "rouge_2"))
    return means.select(F.round("rouge_1", 5).alias("rouge_1"), F.round("rouge_2", 5).alias("rouge_2"))


# -- bootstrap ----------------------------------------------------------------------------------------

def h(*parts):
    return hash60("concat_ws('|', '42', " + ", ".join(parts) + ")", "duckdb")


N_BOOT = 1000


def _u32(x: str) -> str:
    return f"(({x}) & 4294967295::ubigint)"


def _mix32(x: str) -> str:
    """A hash of 32-bit words, kept in 64 bits so that products do not overflow."""
    x = f"xor({x}, ({x}) >> 16)"
    x = _u32(f"{x} * 2146121005::ubigint")
    x = _u32(f"xor({x}, {x} >> 15) * 2221713035::ubigint")
    return f"xor({x}, {x} >> 16)"


def _node_keys(start: str, end: str) -> str:
    one, two = bootstrap.seed_words(42)
    return (
        f"{_mix32(f'xor({_mix32(f'xor({one}::ubigint, b::ubigint)')}, ({start})::ubigint)')} as k1, "
        f"{_mix32(f'xor({_mix32(f'xor({two}::ubigint, b::ubigint)')}, ({end})::ubigint)')} as k2"
    )


def _word(step: str, j: str) -> str:
    return _mix32(f"xor({_mix32(_u32(f'k1 + ({j})::ubigint * 2654435769::ubigint'))}, {_mix32(_u32(f'k2 + ({step})::ubigint'))})")


def d_draws(totals: str) -> str:
    """CTEs that end in draws(b, idx) for <totals>(b, n, rows): the tree of counts as a recursion, then every draw of its leaves.

    A node is split digit by digit: ``open`` draws are undecided, ``rest`` of ``total`` is the
    remainder of the probability of its left half.
    """
    size = bootstrap.BLOCK
    ones = f"""list_sum(list_transform(range((open + 31) // 32), lambda j: bit_count(({_word("step", "j")} & case when 32 * (j + 1) <= open
        then 4294967295::ubigint else (1::ubigint << (open - 32 * j)::ubigint) - 1 end)::bigint)))::bigint"""
    half = f"(((first + last) // 2 - first) * {size})"
    return f"""nodes as (
        select b, rows, 0::bigint as first, ((rows + {size - 1}) // {size})::bigint as last, n::bigint as n, 1::bigint as step, n::bigint as open, 0::bigint as lft, null::bigint as rest from {totals}
        union all
        select b, rows, x.first, x.last, x.n, x.step, x.open, x.lft, x.rest from (
          select b, rows, unnest(case when open > 0 and coalesce(rest, 1) > 0 then
              [{{first: first, last: last, n: n, step: step + 1, open: case when digit then ones else open - ones end, lft: lft + case when digit then open - ones else 0 end, rest: twice - case when digit then total else 0 end}}]
            else [{{first: first, last: (first + last) // 2, n: lft, step: 1::bigint, open: lft, lft: 0::bigint, rest: null::bigint}},
                  {{first: (first + last) // 2, last: last, n: n - lft, step: 1::bigint, open: n - lft, lft: 0::bigint, rest: null::bigint}}] end) as x
          from (select *, 2 * coalesce(rest, {half}) as twice, 2 * coalesce(rest, {half}) >= total as digit, {ones} as ones
            from (select *, least(last * {size}, rows) - first * {size} as total, {_node_keys("first", "last")} from nodes where last - first > 1 and n > 0) y) z) w),
      leaves as (select b, rows, first, n, {_node_keys("first", "first")} from nodes where last - first = 1 and n > 0 and step = 1),
      draws as (select b, first * {size} + (({_word("0", "j")} * least({size}, rows - first * {size})::ubigint) >> 32)::bigint as idx from (select *, unnest(range(n)) as j from leaves) x)"""


def d_order(key: str) -> str:
    return f"md5('42|' || {key}::varchar), {key}"


@query(
    "i16_bootstrap_mean",
    f"""with recursive r as (select bbox_iou as v, row_number() over (order by {d_order("example_id")}) - 1 as idx from v_eval where bbox_iou is not null),
        tot as (select unnest(range({N_BOOT})) as b, count(*) as n, count(*) as rows from r), {d_draws("tot")},
        m as (select b, avg(v) as m from draws join r using (idx) group by 1) select round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std from m""",
)
def i16(d: Data):
    return rounded(bootstrap.bootstrap_mean(d.view("v_eval"), "bbox_iou", ["example_id"], N_BOOT), "mean", "std")


def _poisson():
    out, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(13):
        p = p if k == 0 else p / k
        total += p
        out.append(f"(u >= cast('{total!r}' as double))::int")
    return " + ".join(out)


@query(
    "i16_poisson_bootstrap",
    f"""with d as (select b, bbox_iou as v, {h("'poisson'", "b::varchar", "example_id::varchar")} / cast(1152921504606846976 as double) as u from (select example_id, bbox_iou, unnest(range({N_BOOT})) as b from v_eval where bbox_iou is not null) x),
        m as (select b, sum(v * k) / sum(k) as m from (select b, v, {_poisson()} as k from d) y group by 1) select round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std from m""",
)
def i16_poisson(d: Data):
    return rounded(bootstrap.poisson_bootstrap_mean(d.view("v_eval"), "bbox_iou", ["example_id"], N_BOOT), "mean", "std")


@query(
    "i17_bootstrap_by_category",
    f"""with recursive r as (select category, text_score as v, row_number() over (order by {d_order("example_id")}) - 1 as idx,
          row_number() over (partition by category order by {d_order("example_id")}) as place from v_eval where category is not null and text_score is not null),
        tot as (select unnest(range({N_BOOT})) as b, count(*) - count(distinct category) as n, count(*) as rows from r), {d_draws("tot")},
        sure as (select x.b, r.idx from (select category, b, {h("'sure'", "b::varchar", "category")} % size + 1 as place from (select category, count(*) as size, unnest(range({N_BOOT})) as b from r group by 1) y) x join r using (category, place)),
        s as (select b, category, sum(v) as s, count(*) as n, sum(v) / count(*) as m from (select * from draws union all select * from sure) d join r using (idx) group by 1, 2), p as (select b, sum(s) / sum(n) as micro, avg(m) as macro from s group by 1)
        select 'micro' as level, null as category, round(avg(micro), 6) as mean, round(stddev_pop(micro), 6) as std from p union all select 'macro', null, round(avg(macro), 6), round(stddev_pop(macro), 6) from p
        union all select 'category', category, round(avg(m), 6), round(stddev_pop(m), 6) from s group by 2""",
)
def i17(d: Data):
    return rounded(bootstrap.bootstrap_by_category(d.view("v_eval"), "text_score", "category", ["example_id"], N_BOOT), "mean", "std")


def d_multilabel(positive, score):
    return f"""with recursive sm as (select doc_id, row_number() over (order by {d_order("doc_id")}) - 1 as idx from (select distinct doc_id from v_labels) x),
    ps as (select doc_id, class, row_number() over (partition by class order by {d_order("doc_id")}) as place from ({positive}) x),
    su as (select distinct b, idx from (select class, b, {h("'sure'", "b::varchar", "class")} % size + 1 as place from (select class, count(*) as size, unnest(range({N_BOOT})) as b from ps group by 1) x) y join ps using (class, place) join sm using (doc_id)),
    tot as (select b, (select count(*) from sm) - coalesce(k, 0) as n, (select count(*) from sm) as rows from (select unnest(range({N_BOOT})) as b) x left join (select b, count(*) as k from su group by 1) y using (b)), {d_draws("tot")},
    tm as (select b, idx, count(*) as k from (select * from draws union all select * from su) z group by 1, 2),
    ct as (select b, class, sum(case when y_true = 1 and y_pred = 1 then k else 0 end) as tp, sum(case when y_true <> 1 and y_pred = 1 then k else 0 end) as fp, sum(case when y_true = 1 and y_pred <> 1 then k else 0 end) as fn,
      sum(case when (y_true = 1) = (y_pred = 1) then k else 0 end) as same, sum(k) as labels
      from tm join sm using (idx) join v_labels using (doc_id) group by 1, 2),
    f as ({score}) select round(avg(f), 6) as mean, round(stddev_pop(f), 6) as std from f"""


_POSITIVE = "select doc_id, class from v_labels where y_true > 0"
_ANY = "select distinct doc_id, 'any' as class from v_labels where y_true > 0"
_CLASS_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"


@query("i18_bootstrap_multilabel_micro", d_multilabel(_POSITIVE, "select b, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) as f from ct group by 1"))
def i18_micro(d: Data):
    return rounded(bootstrap.bootstrap_multilabel(d.view("v_labels"), "doc_id", "micro", N_BOOT), "mean", "std")


@query("i18_bootstrap_multilabel_macro", d_multilabel(_ANY, f"select b, avg({_CLASS_F1}) as f from ct group by 1"))
def i18_macro(d: Data):
    out = bootstrap.bootstrap_multilabel(d.view("v_labels"), "doc_id", "macro", N_BOOT, ensure_all_classes=False, drop_empty_classes=True)
    return rounded(out, "mean", "std")


@query("i18_bootstrap_multilabel_weighted", d_multilabel(_POSITIVE, f"select b, coalesce(sum({_CLASS_F1} * (tp + fn)) / nullif(sum(tp + fn), 0), 0) as f from ct group by 1"))
def i18_weighted(d: Data):
    return rounded(bootstrap.bootstrap_multilabel(d.view("v_labels"), "doc_id", "weighted", N_BOOT), "mean", "std")


@query("i18_bootstrap_plugged_metric", d_multilabel(_ANY, "select b, min(tp / nullif(tp + fn, 0)) as f from ct group by 1"))
def i18_plugged(d: Data):
    # The recall of the worst class, as a metric that the library does not have.
    recall = bootstrap.LabelMetric(lambda t, p: {"hit": t & p, "true": t}, lambda: F.min(F.try_divide("hit", "true")))
    return rounded(bootstrap.bootstrap_multilabel(d.view("v_labels"), "doc_id", recall, N_BOOT, ensure_all_classes=False), "mean", "std")


@query("i18_bootstrap_accuracy", d_multilabel(_POSITIVE, "select b, sum(same) / sum(labels) as f from ct group by 1"))
def i18_accuracy(d: Data):
    return rounded(bootstrap.bootstrap_multilabel(d.view("v_labels"), "doc_id", "accuracy", N_BOOT), "mean", "std")


# -- plug-ins ------------------------------------------------------------------------------------------

@query(
    "i19_memoized_scores",
    f"select pair_id, len(list_filter(string_split({d_squeeze('hyp')}, ' '), lambda x: x <> '')) as n_words, length(hyp) as n_chars from v_pairs",
)
def i19(d: Data):
    rows = pairs(d)
    model = plugins.text_model(lambda texts: [(len(t.split()), len(t)) for t in texts], "n_words bigint, n_chars bigint")
    cache = work_folder(d.spark, "memo")
    # The references fill the cache; a hypothesis that is a reference elsewhere is not scored again.
    plugins.memoized(rows.select("ref"), "ref", model, cache)
    return plugins.memoized(rows.select("pair_id", "hyp"), "hyp", model, cache).select("pair_id", "n_words", "n_chars")


@query(
    "l1_text_model",
    "select count(*) as n, sum(length(text))::bigint as n_chars, sum(length(text) - length(replace(text, 'e', '')))::bigint as n_e from (select distinct text from documents) a",
)
def l1(d: Data):
    keyed = d.table("documents").select(text.text_key("text").alias("key"), "text").dropDuplicates(["key"])
    model = plugins.text_model(lambda texts: [(len(t), t.count("e")) for t in texts], "n_chars bigint, n_e bigint", 64)
    out = model(keyed)
    return out.agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.sum("n_e").alias("n_e"))


@query("l3_register_metric", "select pair_id, round(length(hyp) / (length(hyp) + length(ref)), 6) as length_share from v_pairs")
def l3(d: Data):
    share = F.length("hyp") / (F.length("hyp") + F.length("ref"))
    plugins.register_metric("length_share", lambda p: p.select("pair_id", r6(share).alias("length_share")))
    return plugins.compute_metrics(pairs(d), ["length_share"])
