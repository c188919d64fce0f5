"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found in every whole text; their values are hashed and counted over the corpus by distinct repositories
and owners. A value that many owners or very many repositories share is an example that everyone copies; a value of few
that looks random is a live-looking credential; the rest is weak. Besides the base patterns, long mixed tokens are
candidates; they join the spans only if the corpus shows them to be live-looking.

Each pattern goes over a text once for its matches and once for the gaps between them. From there on a match is a row of
lengths and a hash; running sums of gaps and matches give code-point offsets, running extremes tell which extra
candidates overlap base ones, so a text takes time in proportion to its matches. Tables in the shared folder hold no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: kind, pattern (the last group, if any, is the value), least length of the value, whether it is a base pattern.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True),
    ("access", r"AKIA[A-Z0-9]+", 20, True),
    ("hex", r"[0-9a-f]{24,}", 24, True),
    ("opaque", r"[A-Za-z0-9_-]{24,}", 24, False),
)
#: From so many owners, or repositories (counted within owners), a value is an example.
MIN_OWNERS, MIN_REPOS = 3, 100
MASK = "[secret]"
#: Code points of a chunk of a text that is masked.
CHUNK = 4096
#: A text that none of these finds has no match that is long enough.
_LIKELY = (PATTERNS[0][1], "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}", "[A-Za-z0-9_-]{24}")
_MATCH = "struct<rank:int,gap:int,length:int,value_length:int,good:boolean,strong:boolean,hash:string>"


def _matches(text: Column, rank: int) -> Column:
    """All matches of one pattern in a text, in order, each with the length of the gap before it; those not good take their text but are no candidates."""
    kind, pattern, least, _ = PATTERNS[rank]
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def match(x: Column) -> Column:
        value = F.regexp_extract(x["m"], pattern, 2) if kind == "assign" else x["m"]
        good, mixed = F.length(value) >= least, value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 8)
        if kind == "opaque":
            good = good & value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
        strong = mixed if kind == "assign" else F.lit(True)
        return F.struct(
            F.lit(rank).alias("rank"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("length"), F.length(value).alias("value_length"),
            good.alias("good"), strong.alias("strong"), F.when(good, F.sha2(value, 256)).alias("hash"),
        )

    found = F.transform(F.filter(pairs, lambda x: x["m"].isNotNull()), match).cast(f"array<{_MATCH}>")
    return F.when(text.rlike(_LIKELY[rank]), found).otherwise(F.array().cast(f"array<{_MATCH}>"))


def matches(text: Column) -> Column:
    """The matches of all patterns in a text, one pattern after another."""
    return F.concat(*[_matches(text, r) for r in range(len(PATTERNS))])


def ownership(found: DataFrame, min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """hash, owners, repos, verdict (example, live, weak) of each candidate value; found is (owner, repo, hash, strong).

    Null owners or repositories are one of their own. Counts are summed within (hash, owner, repo) and (hash, owner)
    before they meet by hash, so a value that a third of all rows hold is not gathered anywhere.
    """
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.max("strong").alias("strong"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("strong").alias("strong"))
    counted = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("strong").alias("strong"))
    example = (F.col("owners") >= min_owners) | (F.col("repos") >= min_repos)
    return counted.select("hash", "owners", "repos", F.when(example, "example").when(F.col("strong"), "live").otherwise("weak").alias("verdict"))


def _candidates(rows: DataFrame) -> DataFrame:
    """One row a candidate of rows (__row, __owner, __repo, __matches): __row, owner, repo, start, end, rank, base, value_start, strong, hash.

    Extra candidates that overlap a base one are left out. All matches of a row meet in one task, as rows.
    """
    each = rows.select("__row", F.col("__owner").alias("owner"), F.col("__repo").alias("repo"), F.posexplode("__matches").alias("nth", "m")).repartition("__row")
    upto = Window.partitionBy("__row", "m.rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.length")).over(upto).cast("int")
    base = F.element_at(F.array(*[F.lit(p[3]) for p in PATTERNS]), F.col("m.rank") + 1)
    spans = each.withColumn("end", end).filter("m.good").select(
        "__row", "owner", "repo", (F.col("end") - F.col("m.length")).alias("start"), "end", F.col("m.rank").alias("rank"), base.alias("base"),
        (F.col("end") - F.col("m.value_length")).alias("value_start"), F.col("m.strong").alias("strong"), F.col("m.hash").alias("hash"),
    )
    so_far = lambda *order: Window.partitionBy("__row").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.max(F.when(F.col("base"), F.col("end"))).over(so_far("start", "rank"))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(so_far(F.desc("start"), F.desc("rank")))  # backwards: a frame that runs on to the end is added up anew for each row
    apart = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    return spans.withColumn("apart", apart).filter("base OR apart").drop("apart")


def _judged(rows: DataFrame, min_owners: int, min_repos: int) -> DataFrame:
    """Candidates of rows with their verdict, owners and repos. Both tables are written, so that the join can split a value that a third of the rows hold."""
    found = keep(_candidates(rows), "secret-candidates")
    verdicts = keep(ownership(found.select("owner", "repo", "hash", "strong"), min_owners, min_repos), "secret-verdicts")
    kind = F.element_at(F.array(*[F.lit(p[0]) for p in PATTERNS]), F.col("rank") + 1)
    return found.join(verdicts, "hash").select("__row", "start", "rank", "end", kind.alias("kind"), "base", "verdict", "owners", "repos", "value_start")


def _with_matches(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    """The rows of docs as __doc, so that no column of theirs can clash, with a number, owner, repository and matches."""
    return docs.select(
        F.struct("*").alias("__doc"), F.monotonically_increasing_id().alias("__row"), docs[owner].cast("string").alias("__owner"), docs[repo].cast("string").alias("__repo"),
        matches(F.coalesce(docs["text"], F.lit(""))).alias("__matches"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """doc_id and judged spans (start, rank, end, kind, base, verdict, owners, repos) by start and kind of every row of docs (doc_id, text, owner, repo).

    Null text is empty. Null owners or repositories are one of their own. A row without candidates has no spans;
    repeated rows are judged each and count as one repository if owner and repo agree. An empty table gives an empty
    result; columns that aren't named are not read, so their names can't clash. Texts are read once.
    """
    own = list(dict.fromkeys(["doc_id", "text", owner, repo]))
    rows = keep(_with_matches(docs.select(*own), owner, repo).select("__doc.doc_id", "__row", "__owner", "__repo", "__matches"), "secret-matches")
    span = F.struct("start", "rank", "end", "kind", "base", "verdict", "owners", "repos")
    judged = _judged(rows.filter(F.size("__matches") > 0), min_owners, min_repos).groupBy("__row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(judged.schema["spans"].dataType)
    some = rows.filter(F.size("__matches") > 0).select("__row", "doc_id").join(judged, "__row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return some.unionByName(rows.filter(F.size("__matches") == 0).select("doc_id", none.alias("spans")))


def _masked(text: Column, live: Column, mask: str) -> Column:
    """text with the mask for each span of live (value_start, end, from: the end of the spans before it).

    The text is cut into chunks once, as a place deep in a string takes time to reach; a piece comes from the chunks it lies in.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))

    def piece(of: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        within = F.substring(F.get(of, first), start % CHUNK + 1, end - start)
        whole = F.array_join(F.slice(of, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        across = F.concat(F.substring(F.get(of, first), start % CHUNK + 1, F.lit(CHUNK)), whole, F.substring(F.get(of, last), F.lit(1), end % CHUNK))
        return F.when(start >= end, "").when(first == last, within).otherwise(across)

    def built(x: Column) -> Column:
        spans = F.transform(x["live"], lambda s: F.concat(piece(x["chunks"], s["from"], s["value_start"]), F.when(s["end"] > s["from"], F.lit(mask)).otherwise(F.lit(""))))
        return F.concat(F.array_join(spans, ""), piece(x["chunks"], F.array_max(F.transform(x["live"], lambda s: s["end"])), F.length(text)))

    one = F.array(F.struct(chunks.alias("chunks"), live.alias("live")))  # binds the chunks, so that they are cut once a text
    return F.get(F.transform(one, built), F.lit(0))


def redact(docs: DataFrame, owner: str = "source", repo: str = "doc_id", min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS, mask: str = MASK) -> DataFrame:
    """docs with the values of live-looking credentials masked in text; examples that many share stay. All columns and rows are kept.

    Null text stays null; repeated rows are masked alike; columns of any name are kept, as docs travels in one column; an
    empty table gives an empty result. Patterns go over each text once: docs is written with its matches, and only
    rows with live values are joined.
    """
    tagged = keep(_with_matches(docs, owner, repo), "secret-rows")
    judged = _judged(tagged.filter(F.size("__matches") > 0).select("__row", "__owner", "__repo", "__matches"), min_owners, min_repos).filter("verdict = 'live'")
    earlier = F.coalesce(F.max("end").over(Window.partitionBy("__row").orderBy("value_start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = judged.select("__row", "value_start", "end", earlier.alias("from")).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("value_start", "end", "from"))).alias("__live"))
    masked = F.when(F.col("__live").isNull(), F.col("__doc.text")).otherwise(_masked(F.col("__doc.text"), F.col("__live"), mask))
    some = tagged.filter(F.size("__matches") > 0).join(live, "__row", "left").select(F.col("__doc").withField("text", masked).alias("__doc"))
    return some.select("__doc.*").unionByName(tagged.filter(F.size("__matches") == 0).select("__doc.*"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    shown = F.filter("spans", lambda s: s["base"] | (s["verdict"] == "live"))
    count = lambda what: F.size(F.filter("spans", what)).cast("long")
    of_kind = lambda kind: lambda s: s["base"] & (s["kind"] == kind)
    return found.select(
        "doc_id", *[count(of_kind(k)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(shown).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "example").alias("n_example"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["repos"])), F.lit(0)).cast("long").alias("most_repos"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS owner, coalesce(doc_id::VARCHAR, chr(0)) AS repo, coalesce(text, '') AS t FROM documents
), p(rank, kind, least, grp, base, pattern) AS (VALUES
  (0, 'assign', 6, 2, true, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 20, 0, true, 'AKIA[A-Z0-9]+'), (2, 'hex', 24, 0, true, '[0-9a-f]+'), (3, 'opaque', 24, 0, false, '[A-Za-z0-9_-]+')
), m AS (
  SELECT r, doc_id, owner, repo, 0 AS rank, regexp_extract_all(t, (SELECT pattern FROM p WHERE rank = 0), 0) AS ms,
         regexp_extract_all(t, (SELECT pattern FROM p WHERE rank = 0), 2) AS vs, string_split_regex(t, (SELECT pattern FROM p WHERE rank = 0)) AS gs FROM d
  UNION ALL SELECT r, doc_id, owner, repo, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, doc_id, owner, repo, 2, regexp_extract_all(t, '[0-9a-f]{24,}', 0), regexp_extract_all(t, '[0-9a-f]{24,}', 0), string_split_regex(t, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT r, doc_id, owner, repo, 3, regexp_extract_all(t, '[A-Za-z0-9_-]{24,}', 0), regexp_extract_all(t, '[A-Za-z0-9_-]{24,}', 0), string_split_regex(t, '[A-Za-z0-9_-]{24,}') FROM d
), u AS (
  SELECT r, doc_id, owner, repo, rank, unnest(range(1, len(ms) + 1)) AS i, ms, vs, gs FROM m WHERE len(ms) > 0
), s AS (
  SELECT r, doc_id, owner, repo, rank, vs[i] AS v,
         (list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS a, length(ms[i]) AS n
  FROM u
), c AS (
  SELECT s.*, a + n AS z, kind, base FROM s JOIN p USING (rank)
  WHERE length(v) >= least AND (base OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]'))
), f AS (
  SELECT *, rank > 0 OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND length(v) >= 8 AS strong
  FROM c WHERE base OR NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.base AND b.a < c.z AND c.a < b.z)
), o AS (
  SELECT v, count(DISTINCT (owner, repo)) AS repos,
         CASE WHEN count(DISTINCT owner) >= 3 OR count(DISTINCT (owner, repo)) >= 100 THEN 'example' WHEN bool_or(strong) THEN 'live' ELSE 'weak' END AS verdict
  FROM f GROUP BY v
), j AS (
  SELECT f.*, verdict, repos FROM f JOIN o USING (v)
)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (WHERE kind = 'access')::BIGINT AS n_access,
       count(*) FILTER (WHERE kind = 'hex')::BIGINT AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (WHERE base), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (WHERE base OR verdict = 'live'), '') AS spans,
       count(*) FILTER (WHERE verdict = 'live')::BIGINT AS n_live, count(*) FILTER (WHERE verdict = 'example')::BIGINT AS n_example,
       coalesce(max(repos), 0)::BIGINT AS most_repos
FROM d LEFT JOIN j ON d.r = j.r GROUP BY d.r, d.doc_id
"""
