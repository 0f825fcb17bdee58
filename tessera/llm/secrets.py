"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Spans are found per text; the value of each is hashed, and hashes are counted by distinct
repositories and owners over the whole corpus.  A value that many owners have is a copied example; a
value of one or few owners looks live.  Formats of known issuers add spans of their own where the
value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, text_or_empty


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: Patterns, by kind in the order that breaks ties of position (fixed values).
NAMES = _either_case("(password|passwd|secret|token|api_?key)")
ASSIGN = rf"""{NAMES}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ISSUED = r"(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{16,}\.eyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"
KINDS = ("assign", "access", "hex", "issued")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, ISSUED), strict=True))
ANY = f"{NAMES}|AKIA|{HEX}|{ISSUED}"
LEAST_VALUE = 6
#: A value of more owners than this, or of more repositories, is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 3


def _of_kind(kind: int):
    return lambda span: span["kind"] == kind


def _hits(text: Column, kind: str) -> Column:
    """Each match with the length of the text before it and since the last match."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    return F.transform(found, lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), F.length(F.get(between, i)).alias("gap"), F.length(m).alias("size"), m.alias("match")))


def secret_spans(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every input row under a row number, and the spans of the rows that have any.

    Spans have row, kind (number), start, stop (code points) and the value's digest.
    """
    text = F.col("text")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols]).alias("repo"), text_or_empty(text_col).alias("text"))
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,match:string>>")
    found = F.when(text.rlike(ANY), F.concat(*[_hits(text, k) for k in KINDS])).otherwise(none)
    # written, so that the row numbers stay as they are
    rows = scratch.keep(base.select("row", "id", "owner", "repo", found.alias("hits")), "hits")
    each = rows.where(F.size("hits") > 0).select("row", "owner", "repo", F.inline("hits"))
    upto = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("row", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0))
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    spans = each.select("row", "owner", "repo", "kind", upto.alias("stop"), (upto - F.col("size")).alias("start"), value.alias("value"))
    return rows, spans.where(F.length("value") >= LEAST_VALUE).withColumn("digest", F.sha2("value", 256)).drop("value")


def ownership(spans: DataFrame) -> DataFrame:
    """digest, n, n_owners, n_repos: pairs are made distinct first, so no digest is gathered whole."""
    pairs = spans.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("digest").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def judged_spans(spans: DataFrame, scratch: Scratch, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``spans`` with ``owned`` (n_owners, n_repos, live): live if both numbers are within their bounds.  A digest that one in a thousand spans has is looked up by broadcast
    (there are a thousand of them at most), so no key of the other join is hot."""
    spans = scratch.keep(spans, "spans")
    counts = scratch.keep(ownership(spans).select("digest", "n", F.struct("n_owners", "n_repos", ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("live")).alias("owned")), "owners")
    often = max(1000, spans.count() // 1000)
    hot = F.broadcast(counts.where(F.col("n") >= often).select("digest", F.col("owned").alias("hot_owned")))
    rest = counts.where(F.col("n") < often).select("digest", "owned")
    marked = spans.join(hot, "digest", "left")
    plain = marked.where(F.col("hot_owned").isNull()).drop("hot_owned").join(rest, "digest")
    return marked.where(F.col("hot_owned").isNotNull()).withColumnRenamed("hot_owned", "owned").unionByName(plain).withColumn("live", F.col("owned.live"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, and ``owned``: of each
    span in the same order the number of distinct owners and of repositories that have its value, joined likewise.

    Null text counts as empty and has no spans: zeros, the digest of nothing and an empty string.
    Spans of one start are ordered by kind.  A null owner or repository is one unnamed owner.
    Repeated rows are scanned one by one and count as one repository; identifiers may be null or
    repeated; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows, spans = secret_spans(docs, id_col, text_col, owner_col, repo_cols, scratch)
    shown = judged_spans(spans, scratch, max_owners, max_repos).where((F.col("kind") < 3) | F.col("live"))
    one = F.struct("start", "kind", "stop", "live", F.col("owned.n_owners").alias("owners"), F.col("owned.n_repos").alias("repos"))
    per_row = shown.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("found"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda test: F.coalesce(F.size(F.filter("found", test)), F.lit(0)).cast("long")
    return (
        rows.select("row", "id")
        .join(per_row, "row", "left")
        .withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,live:boolean,owners:bigint,repos:bigint>>")))
        .select(
            F.col("id").alias("doc_id"),
            *[count(_of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
            F.sha2(line(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
            line(F.col("found")).alias("spans"),
            count(lambda s: s["live"]).alias("n_live"),
            count(lambda s: ~s["live"]).alias("n_copied"),
            F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["owners"].cast("string"), s["repos"].cast("string"))), ",").alias("owned"),
        )
    )


def redact_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each live-looking span replaced by ``mark``; copied examples stay.

    Only texts that may hold a span are written and joined; all others pass straight through.
    Overlapping spans are replaced as one.  Null texts stay null.
    """
    scratch = Scratch(docs.sparkSession)
    may = F.coalesce(F.col(text_col).cast("string").rlike(ANY), F.lit(False))
    whole = docs.where(may).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    held = scratch.keep(whole.select("*", F.monotonically_increasing_id().alias("at")), "held")
    flat = held.select(F.col("at").alias("id"), F.col(f"whole.`{text_col}`").alias("text"), F.col(f"whole.`{owner_col}`").alias("owner"), *[F.col(f"whole.`{c}`").alias(f"repo{i}") for i, c in enumerate(repo_cols)])
    rows, spans = secret_spans(flat, "id", "text", "owner", tuple(f"repo{i}" for i in range(len(repo_cols))), scratch)
    live = judged_spans(spans, scratch, max_owners, max_repos).where("live")
    # what a span leaves of those before it
    before = W.partitionBy("row").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    cuts = live.withColumn("from", F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0)))).withColumn("fresh", F.col("from") == F.col("start")).where(F.col("stop") > F.col("from"))
    per_row = cuts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", "stop", "fresh"))).alias("cuts")).join(rows.select("row", F.col("id").alias("at")), "row").drop("row")
    text = F.col(f"whole.`{text_col}`")
    end = lambda i: F.when(i < 0, F.lit(0)).otherwise(F.get("cuts", i)["stop"])
    pieces = F.transform("cuts", lambda c, i: F.concat(F.substring(text, (end(i - 1) + 1).cast("int"), (c["from"] - end(i - 1)).cast("int")), F.when(c["fresh"], F.lit(mark)).otherwise(F.lit(""))))
    tail = F.substring(text, (F.get("cuts", F.size("cuts") - 1)["stop"] + 1).cast("int"), F.length(text))
    clean = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    joined = held.join(per_row, "at", "left")
    mended = joined.select(*[(clean if c == text_col else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])
    return docs.where(~may).unionByName(mended)


def op8_secret_scan(spark, sf_dir):
    return scan_secrets(documents(spark, sf_dir))


def _sql() -> str:
    between = lambda kind: f"regexp_split_to_array(text, '{PATTERNS[kind].replace(chr(39), chr(39) * 2)}')"
    quoted = {k: v.replace("'", "''") for k, v in PATTERNS.items()}
    parts = [
        f"SELECT doc_id, source, lang, {i} AS kind, unnest(range(len(m))) AS nth, m, g FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '{quoted[k]}') AS m, {between(k)} AS g FROM t)"
        for i, k in enumerate(KINDS)
    ]
    return rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
h AS ({' UNION ALL '.join(parts)}),
s AS (
  SELECT doc_id, source, lang, kind, m[nth + 1] AS match,
    list_sum(list_transform(g[1:nth + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:nth], lambda x: length(x))), 0) AS start
  FROM h
),
v AS (SELECT *, start + length(match) AS stop, CASE WHEN kind = 0 THEN regexp_extract(match, '{quoted['assign']}', 2) ELSE match END AS value FROM s),
o AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT source || '/' || lang) AS repos FROM v WHERE length(value) >= {LEAST_VALUE} GROUP BY value),
j AS (
  SELECT v.*, o.owners <= {MAX_OWNERS} AND o.repos <= {MAX_REPOS} AS live, o.owners || ':' || o.repos AS owned, ['assign', 'access', 'hex', 'issued'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS line
  FROM v JOIN o USING (value) WHERE kind < 3 OR (o.owners <= {MAX_OWNERS} AND o.repos <= {MAX_REPOS})
),
d AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(line, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(line, ',' ORDER BY start, kind) AS spans, string_agg(owned, ',' ORDER BY start, kind) AS owned,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM j GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(owned, '') AS owned
FROM t LEFT JOIN d USING (doc_id)
"""


OP8_SQL = _sql()
