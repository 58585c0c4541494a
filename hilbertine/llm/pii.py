"""Personal data: fixed patterns, and terms that give protected entities away.

Information-theoretic sanitisation: what the patterns find is protected, at two
levels: the value itself, and what several values share, such as the user name or the
domain of an address, the network of an IP number, the issuer of a card, the
area of a telephone number. All these are the entities. Over the documents of the whole
corpus, a term's co-occurrence with an entity estimates the information that
it discloses, the point-wise mutual information PMI(term; entity) = log2 of n * n_tc / (n_t * n_c);
the entity's own information content is IC(entity) = log2(n / n_c). A term for which PMI >= threshold * IC
gives the entity away and is generalised like the entity itself, wherever
it stands: far from the entity, or in a text without it. Such an estimate needs
``support``: as many different texts with both, copies not counting.

All counts are numbers of documents. Term and entity are paired within the texts
that hold an entity only, and only if the bounds of n_tc by either's own count
don't rule the pair out already.

Everything is made of DataFrame functions. Positions are code points and come
from the matches and the stretches between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise

KINDS = ("email", "ip", "card", "phone", "term")

# The anchors in front keep a search from starting inside a run that it has
# already refused; what is found is the same as without them.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A term is a run of at least so many letters; marks that combine with a letter belong to it.
TERM = r"\p{L}[\p{L}\p{M}]{2,}"

#: A term discloses an entity from this share of its information on, and from so many distinct texts with both.
THRESHOLD, SUPPORT = 0.9, 3
#: Most disclosing terms that travel to the tasks as a set; beyond it their texts are found by a shuffle join.
TERM_BOUND = 20_000

SPANS = "array<struct<s:int,k:int,e:int>>"


def spans_of(text: str, pattern: str, kind: int, keep: str = "true", offset: str = "0") -> str:
    """SQL for the spans (start, kind, end) of ``pattern`` in ``text`` whose match ``m`` passes ``keep``."""
    p = pattern.replace("\\", "\\\\")
    found = f"regexp_extract_all({text}, '{p}', 0)"
    return (
        f"if(size({found}) = 0, cast(array() as {SPANS}), aggregate(zip_with(slice(split({text}, '{p}', -1), 1, size({found})), {found}, (g, m) -> struct(length(g) as g, length(m) as l, {keep} as ok)), "
        f"struct({offset} as at, cast(array() as {SPANS}) as out), (a, x) -> struct(a.at + x.g + x.l as at, if(x.ok, array_append(a.out, struct(a.at + x.g as s, {kind} as k, a.at + x.g + x.l as e)), a.out) as out), a -> a.out))"
    )


def base_spans(text: str = "txt") -> Column:
    """The sorted spans of the fixed patterns; each is looked for only where its rarest character stands."""
    ip_ok = f"m rlike '^{OCTET}(\\\\.{OCTET}){{3}}$'"
    card_ok = "luhn_check(regexp_replace(m, '[ -]', ''))"
    phone_ok = "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15"
    parts = [
        f"if(contains({text}, '@'), {spans_of(text, EMAIL, 0)}, cast(array() as {SPANS}))",
        spans_of(text, IP, 1, ip_ok), spans_of(text, CARD, 2, card_ok),
        f"if(contains({text}, '+'), {spans_of(text, PHONE, 3, phone_ok)}, cast(array() as {SPANS}))",
    ]
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def _entities() -> str:
    """SQL for the entities that a span ``b`` of ``txt`` stands for, as hashes: its value, and what it shares with others."""
    value = "lower(substring(txt, b.s + 1, b.e - b.s))"
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    shared = (
        f"case b.k when 0 then array(concat('user ', regexp_replace(substring_index({value}, '@', 1), '[^a-z]+', ' ')), concat('domain ', substring_index({value}, '@', -1))) "
        f"when 1 then array(concat('net ', substring_index({value}, '.', 3))) when 2 then array(concat('issuer ', substring({digits}, 1, 6))) else array(concat('area ', substring({digits}, 1, 6))) end"
    )
    return f"transform(array_append({shared}, concat('value ', if(b.k < 2, {value}, {digits}))), x -> xxhash64(b.k, x))"


def _found_terms(text: str) -> str:
    p = TERM.replace("\\", "\\\\")
    return f"regexp_extract_all({text}, '{p}', 0)"


def _terms(texts: DataFrame) -> DataFrame:
    """(h, term, s, e) for each term of ``texts`` (h, txt, base) that overlaps none of its base spans.

    Places are sums over the stretches before; rows of a text, not an array that grows by copying.
    """
    p = TERM.replace("\\", "\\\\")
    each = texts.select("h", "base", F.expr(f"posexplode(zip_with({_found_terms('txt')}, slice(split(txt, '{p}', -1), 1, size({_found_terms('txt')})), (m, g) -> struct(m, g)))").alias("i", "x"))
    end = F.sum(F.expr("length(x.g) + length(x.m)")).over(Window.partitionBy("h").orderBy("i"))
    placed = each.select("h", "base", F.expr("lower(x.m)").alias("term"), end.cast("int").alias("e"), F.expr("length(x.m)").alias("l")).withColumn("s", F.expr("e - l"))
    return placed.filter("not exists(base, x -> x.s < e and s < x.e)").select("h", "term", "s", "e")


def _term_counts(texts: DataFrame) -> DataFrame:
    """(term, n_t): in how many documents each term stands."""
    return texts.select(F.explode(F.expr(f"array_distinct(transform({_found_terms('txt')}, x -> lower(x)))")).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosing_terms(found: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(term) for each term of ``texts`` (h, txt) that gives an entity away.

    ``found`` (h, txt, base) has the base spans of each row, and its txt where there are any.
    """
    copies = found.filter("size(base) > 0").groupBy("h").agg(F.count("*").alias("copies"))
    private = materialise(found.filter("size(base) > 0").select("h", "txt", "base").dropDuplicates(["h"]).join(copies, "h"))
    n = found.count() or 1
    each = private.select("h", "copies", "txt", F.explode("base").alias("b")).select("h", "copies", F.explode(F.expr(_entities())).alias("entity")).distinct()
    entities = materialise(each)
    n_c = entities.groupBy("entity").agg(F.sum("copies").alias("n_c"), F.count("*").alias("n")).filter(F.col("n") >= support).select("entity", "n_c")
    # the joins are the same at every size
    supported = materialise(entities.join(n_c.hint("merge"), "entity"))
    near = materialise(_terms(private.select("h", "txt", "base")).select("h", "term").distinct().join(private.select("h", "copies"), "h"))
    most = f"{{}} * pow({n} / {{}}, {1 - threshold}) + 1e-9"  # documents that the term may be in, by n_tc and n_c
    n_near = near.groupBy("term").agg(F.sum("copies").alias("n_near"), F.count("*").alias("n")).filter(F.col("n") >= support).select("term", "n_near")
    terms = materialise(n_near.join(_term_counts(texts), "term").filter(F.expr(f"n_t <= {most.format('n_near', support)}")).select("term", "n_near", "n_t"))
    pairs = near.join(terms.hint("merge"), "term").join(supported.select("h", "entity", "n_c").hint("merge"), "h").filter(F.expr(f"n_t <= {most.format('least(n_near, n_c)', 'n_c')}"))
    together = pairs.groupBy("entity", "term", "n_c", "n_t").agg(F.sum("copies").alias("n_tc"), F.count("*").alias("n")).filter(F.col("n") >= support)
    return materialise(together.filter(F.expr(f"n_t <= {most.format('n_tc', 'n_c')}")).select("term").distinct())


def _holders(texts: DataFrame, terms: DataFrame, bound: int) -> DataFrame:
    """(h, txt) for each different text that holds one of ``terms``."""
    few = terms.limit(bound + 1).collect()
    if len(few) > bound:
        words = texts.select("h", F.explode(F.expr(f"array_distinct(transform({_found_terms('txt')}, x -> lower(x)))")).alias("term"))
        return texts.join(words.join(terms, "term", "left_semi").select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    known = ", ".join(f"'{r[0]}'" for r in few) or "''"  # letters and marks alone
    return materialise(texts.filter(F.expr(f"exists({_found_terms('txt')}, x -> lower(x) in ({known}))"))).dropDuplicates(["h"])


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT, term_bound: int = TERM_BOUND) -> DataFrame:
    """Find personal data in the whole text of ``docs`` (doc_id, text), one row per row.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the
    patterns' spans as kind:start:end), spans (those and the disclosing terms'),
    n_base, n_term and text_key (for ``redact``). A null text is empty; a null doc_id is kept; rows that repeat
    a doc_id are each reported; an empty table gives no rows; other columns are not used.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("txt")).withColumn("h", _text_key("txt"))
    found = materialise(texts.withColumn("base", base_spans()).select("doc_id", "h", F.expr("if(size(base) > 0, txt, null)").alias("txt"), "base"))
    disclosing = disclosing_terms(found, texts, threshold, support)
    marked = _holders(texts.select("h", "txt"), disclosing, term_bound).withColumn("base", base_spans())
    added = _terms(marked).join(disclosing, "term").groupBy("h").agg(F.expr("collect_set(struct(s as s, 4 as k, e as e))").alias("added"))
    rows = found.drop("txt").join(added, "h", "left").withColumn("added", F.expr(f"coalesce(added, cast(array() as {SPANS}))"))
    return rows.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("array_sort(concat(base, added))").alias("spans"),
        F.expr("cast(size(base) as bigint)").alias("n_base"), F.expr("cast(size(added) as bigint)").alias("n_term"), F.col("h").alias("text_key"),
    )


def _text_key(text: str) -> Column:
    return F.xxhash64(F.col(text), F.length(F.col(text)))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with each span of ``found`` generalised to its kind; spans that overlap are replaced as one.

    ``found`` is what ``find_personal_data`` gives for the same texts; a text is looked up by
    itself, so that doc_ids may be null or repeat. All rows and columns stay; a null text stays null.
    """
    pieces = F.expr("transform(filter(split(spans, ','), x -> x != ''), x -> struct(cast(split(x, ':')[1] as int) as s, cast(split(x, ':')[2] as int) as e, split(x, ':')[0] as k))")
    cut = (
        "aggregate(found.cut, struct(0 as at, -1 as till, '' as out), (a, x) -> if(x.s < a.till, struct(greatest(a.at, x.e) as at, greatest(a.till, x.e) as till, a.out as out), "
        "struct(x.e as at, x.e as till, concat(a.out, substring(txt, a.at + 1, x.s - a.at), '[', x.k, ']') as out)), a -> concat(a.out, substring(txt, a.at + 1)))"
    )
    spans = found.filter("spans <> ''").select("text_key", "spans").distinct().select(F.struct("text_key", pieces.alias("cut")).alias("found"))
    whole = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("txt")).withColumn("h", _text_key("txt"))
    text = F.when(F.col("found").isNotNull(), F.expr(cut)).otherwise(F.col("doc.text")).alias("text")
    return whole.join(spans, F.col("h") == F.col("found.text_key"), "left").select(*[text if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
