"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from . import conversations, decontamination, fingerprints, language, line_dedup, ngram_join, packing, pii, secrets, sharding, simhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary that the packing query uses; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), 4, 0.85)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return language.identify(docs, language.train(docs, ~held_out), held_out)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = toxicity.remainder(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_documents(docs, model, held_out)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repair_report(rows, conversations.damaged(rows))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), 3, 2)


def queries() -> dict[str, Query]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return {k: shipped(v) for k, v in sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
 when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as a, doc_id as b from d union select r.a, e.y from r join e on r.b = e.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id
from d left join n on n.doc_id = d.doc_id join (select a, min(b) as c from r group by a) m on m.a = d.doc_id
"""

_CONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
i as (select item, w, least(10, len(w)) as n from b where len(w) > 0),
bw as (select distinct item, n, array_to_string(w[k:k+n-1], ' ') as win from (select item, n, w, unnest(range(1, len(w) - n + 2)) as k from i)),
z as (select distinct n from bw),
dw as (select doc_id, n, k, array_to_string(w[k:k+n-1], ' ') as win from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as k from d, z where len(w) >= n)),
h as (select * from dw where (n, win) in (select (n, win) from bw)),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, item from h join bw using (n, win)) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""


def _repair() -> str:
    """The repair of conversations in SQL: a state's way is its cost in twelve digits and then its audit, so that the least text is the best way."""

    def more(way: str, cost: str, letter: str) -> str:
        return f"lpad(cast(cast(left({way}, 12) as bigint) + {cost} as varchar), 12, '0') || substr({way}, 13) || '{letter}'"

    key = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
    steps = f"list_concat([cast(4294967295 as bigint)], flatten(list_transform(string_split({key}, ''), lambda ch: [cast(ascii(ch) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({steps}, lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)"
    into_user = ", ".join(f"case when free and t = 'u' then {more(w, 'extra', 'K')} end, case when free then {more(w, '3 + extra', 'R')} end" for w in ("w0", "w1", "w3"))
    step = (
        f"select conv_id, i, {more('w0', '4', 'D')} as p0, least({more('w1', '4', 'D')}, case when free and t = 's' then {more('w0', 'extra', 'K')} end) as p1, "
        f"least({more('w2', '4', 'D')}, {into_user}) as p2, least({more('w3', '4', 'D')}, case when free and t = 'a' then {more('w2', 'extra', 'K')} end, case when free then {more('w2', '3 + extra', 'R')} end) as p3 "
        "from (select f.conv_id, f.i, t, fault not in ('b', 'd') as free, case when fault = 't' then 3 else 0 end as extra, w0, w1, w2, w3 from way_ v join f_ f on f.conv_id is not distinct from v.conv_id and f.i = v.i + 1)"
    )
    closed = f"select conv_id, i, p0, p1, least(p2, {more('p0', '3', 'I')}, {more('p1', '3', 'I')}, {more('p3', '3', 'I')}) as p2, p3 from ({step})"
    return rf"""
with recursive c_ as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as kind from conversations),
m_ as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, case kind when 0 then 0 when 3 then 2 else 1 end as n from c_),
r_ as (select conv_id, turn, role, text, unnest(range(n)) as k from m_),
o_ as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, k) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, k) as seen from r_),
f_ as (select conv_id, turn, role, text, i, left(role, 1) as t, lag(left(role, 1)) over (partition by conv_id order by i) as before,
 case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when seen > 1 then 'd' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else '' end as fault from o_),
way_ as (select distinct conv_id, cast(0 as bigint) as i, '000000000000' as w0, cast(null as varchar) as w1, '000000000003I' as w2, '000000000006II' as w3 from f_
 union all select conv_id, i, p0, p1, p2, least(p3, {more('p2', '3', 'I')}) from ({closed})),
n_ as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
 count(*) filter (fault = 't') as truncated, count(*) filter (before is not null and before || t not in ('su', 'ua', 'au')) as illegal from f_ group by conv_id),
b_ as (select n_.*, least(w0, w3) as best from n_ join way_ w on w.conv_id is not distinct from n_.conv_id and w.i = n_.n),
l_ as (select conv_id, best, unnest(range(1, length(best) - 11)) as j from b_),
e_ as (select conv_id, j, substr(best, 12 + j, 1) as e, count(*) filter (substr(best, 12 + j, 1) <> 'I') over w as i, count(*) filter (substr(best, 12 + j, 1) <> 'D') over w as p from l_ window w as (partition by conv_id order by j rows unbounded preceding)),
t_ as (select e_.conv_id, j, e, p, role, text, max(case when p = 1 and e = 'K' and t = 's' then 1 else 0 end) over (partition by e_.conv_id) as led from e_ left join f_ on f_.conv_id is not distinct from e_.conv_id and f_.i = e_.i and e <> 'I' where e <> 'D'),
s_ as (select conv_id, sha256(string_agg(case when e = 'K' then role when (p - led) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by j)) as digest from t_ group by conv_id)
select d.conv_id, {', '.join(f'cast(coalesce({c}, 0) as bigint) as {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(cast(left(best, 12) as bigint), 0) as cost,
 coalesce(substr(best, 13), '') as audit, coalesce(digest, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) d left join b_ on b_.conv_id is not distinct from d.conv_id left join s_ on s_.conv_id is not distinct from d.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose rows plain SQL gives; the others are tested against brute force."""
    return {"op1_ngram_join": _JACCARD, "op5_decontamination": _CONTAMINATION, "op11_conversation_repair": _repair()}
