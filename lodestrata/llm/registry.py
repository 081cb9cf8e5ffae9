"""The pN_ queries over the project's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- 1


def _owned(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.capping import latest

    rows = latest(table(spark, d, "repositories"), "repo_id", ["owner_login", "stars", "created_at", "topics"])
    return rows.withColumn("owner", F.lower(F.trim("owner_login"))).where(F.col("owner") != "")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Repositories beyond the 2 % that an owner may keep, most stars first."""
    from lodestrata.llm.capping import cap_contributors

    rows = _owned(spark, d).select("repo_id", "owner", "stars")
    capped = cap_contributors(rows, "owner", "stars", "repo_id", max_share=(2, 100))
    return capped.where(~F.col("kept")).select("repo_id")


@query
def p1_capped_by_year(spark: SparkSession, d: str) -> DataFrame:
    """The capped set with each owner's slots split over the years of creation."""
    from lodestrata.llm.capping import cap_contributors

    rows = _owned(spark, d).select("repo_id", "owner", "stars", F.substring("created_at", 1, 4).alias("year"))
    capped = cap_contributors(rows, "owner", "stars", "repo_id", max_share=(2, 100), stratum=F.coalesce("year", F.lit("")))
    return capped.where("kept").select("repo_id", "owner", "year")


@query
def p1_capped_by_language(spark: SparkSession, d: str) -> DataFrame:
    """The capped set with each owner's slots split evenly over languages; spare slots go to the others."""
    from lodestrata.llm.capping import cap_contributors, latest

    rows = latest(table(spark, d, "repositories"), "repo_id", ["owner_login", "stars", "primary_language"])
    rows = rows.select("repo_id", F.lower(F.trim("owner_login")).alias("owner"), "stars", F.coalesce("primary_language", F.lit("")).alias("language")).where("owner <> ''")
    capped = cap_contributors(rows, "owner", "stars", "repo_id", max_share=(2, 100), stratum=F.col("language"), even=True)
    return capped.where("kept").groupBy("owner", "language").agg(F.count("*").alias("kept"))


_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fetched_at DESC, fetch_id DESC) rn FROM repositories) WHERE rn = 1)"""
_OWNED = f"""{_LATEST}, owned AS (SELECT repo_id, lower(trim(owner_login, ' ')) AS owner, stars, coalesce(substr(created_at, 1, 4), '') AS year
FROM latest WHERE trim(owner_login, ' ') <> ''), cap AS (SELECT count(*) * 2 // 100 AS cap FROM owned)"""

SQL["p1_found"] = f"""WITH {_OWNED}, ranked AS (SELECT repo_id, row_number() OVER (PARTITION BY owner ORDER BY coalesce(stars, -1) DESC, repo_id) AS pos FROM owned)
SELECT repo_id FROM ranked, cap WHERE pos > cap"""

SQL["p1_capped_by_year"] = f"""WITH {_OWNED}, sizes AS (SELECT owner, year, count(*) n, sum(count(*)) OVER (PARTITION BY owner) total FROM owned GROUP BY 1, 2),
floors AS (SELECT owner, year, n, total, cap, cap * n // total AS fl, (cap * n) % total AS rest FROM sizes, cap),
slots AS (SELECT owner, year, CASE WHEN total <= cap THEN n ELSE fl + CASE WHEN row_number() OVER (PARTITION BY owner ORDER BY rest DESC, year)
  <= cap - sum(fl) OVER (PARTITION BY owner) THEN 1 ELSE 0 END END AS slots FROM floors),
ranked AS (SELECT repo_id, owner, year, row_number() OVER (PARTITION BY owner, year ORDER BY coalesce(stars, -1) DESC, repo_id) AS pos FROM owned)
SELECT repo_id, owner, year FROM ranked JOIN slots USING (owner, year) WHERE pos <= slots"""


SQL["p1_capped_by_language"] = f"""WITH RECURSIVE {_LATEST}, owned AS (SELECT repo_id, lower(trim(owner_login, ' ')) AS owner, coalesce(primary_language, '') AS language FROM latest WHERE trim(owner_login, ' ') <> ''),
cap AS (SELECT count(*) * 2 // 100 AS cap FROM owned), sizes AS (SELECT owner, language, count(*) AS n, sum(count(*)) OVER (PARTITION BY owner) AS total FROM owned GROUP BY 1, 2),
dealt(owner, language, n, total, cap, slots, step) AS (SELECT owner, language, n, total, cap, CAST(0 AS BIGINT), 0 FROM sizes, cap WHERE total > cap
  UNION ALL SELECT owner, language, n, total, cap, CASE WHEN turn <= room THEN slots + 1 ELSE slots END, step + 1 FROM (SELECT *, cap - sum(slots) OVER (PARTITION BY owner) AS room,
    CASE WHEN slots < n THEN row_number() OVER (PARTITION BY owner ORDER BY slots >= n, language) END AS turn FROM dealt) WHERE room > 0)
SELECT owner, language, n AS kept FROM sizes, cap WHERE total <= cap UNION ALL SELECT owner, language, max(slots) AS kept FROM dealt GROUP BY 1, 2 HAVING max(slots) > 0"""


# ---------------------------------------------------------------- 2


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of topics or languages at least four times as frequent together as by chance."""
    from lodestrata.llm.cooccurrence import cooccurrence, list_baskets

    pairs = cooccurrence(list_baskets(table(spark, d, "repositories")), min_count=5, min_lift=(4, 1))
    return pairs.select("field", "item_a", "item_b")


@query
def p2_lift(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that occur together five times, with their counts."""
    from lodestrata.llm.cooccurrence import cooccurrence, list_baskets

    pairs = cooccurrence(list_baskets(table(spark, d, "repositories")), min_count=5)
    return pairs.select("field", "item_a", "item_b", "n_ab", "n_a", "n_b", "n")


_PAIRS = f"""WITH {_LATEST}, lists AS (SELECT repo_id, 'topics' AS field, topics AS raw FROM latest UNION ALL SELECT repo_id, 'languages', languages FROM latest),
items AS (SELECT DISTINCT repo_id, field, lower(trim(item)) AS item FROM (SELECT repo_id, field, unnest(from_json(raw, '["VARCHAR"]')) AS item FROM lists WHERE raw <> '') WHERE trim(item) <> ''),
total AS (SELECT field, count(DISTINCT repo_id) AS n FROM items GROUP BY 1), single AS (SELECT field, item, count(*) AS n_item FROM items GROUP BY 1, 2),
pair AS (SELECT a.field, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM items a JOIN items b ON a.repo_id = b.repo_id AND a.field = b.field AND a.item < b.item GROUP BY 1, 2, 3 HAVING count(*) >= 5),
full_pair AS (SELECT p.field, p.item_a, p.item_b, p.n_ab, x.n_item AS n_a, y.n_item AS n_b, t.n FROM pair p JOIN single x ON x.field = p.field AND x.item = p.item_a
  JOIN single y ON y.field = p.field AND y.item = p.item_b JOIN total t ON t.field = p.field)
"""
SQL["p2_found"] = _PAIRS + "SELECT field, item_a, item_b FROM full_pair WHERE n_ab * n >= 4 * n_a * n_b"
SQL["p2_lift"] = _PAIRS + "SELECT field, item_a, item_b, n_ab, n_a, n_b, n FROM full_pair"


# ---------------------------------------------------------------- 3


def _contents(spark: SparkSession, d: str):
    from lodestrata.llm.dartminhash import near_duplicates

    r = table(spark, d, "repositories")
    content = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("readme_content", F.lit("")))
    return near_duplicates(r.select("repo_id", content.alias("content")), "repo_id", "content", width=3, threshold=(1, 2), min_elements=60)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of repositories with similar content."""
    from lodestrata.llm.dartminhash import linked_ids

    return linked_ids(_contents(spark, d)).select(F.col("id_a").alias("repo_id_a"), F.col("id_b").alias("repo_id_b"))


#: Brute force: all pairs that share a run of three words.
SQL["p3_found"] = """WITH content AS (SELECT DISTINCT repo_id, regexp_extract_all(lower(coalesce(description, '') || ' ' || coalesce(readme_content, '')), '[\\p{L}\\p{N}]+') AS w FROM repositories),
runs AS (SELECT DISTINCT repo_id, hash(w) AS text, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM content WHERE len(w) >= 62),
sizes AS (SELECT repo_id, text, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) >= 60), kept AS (SELECT r.repo_id, r.text, r.run, s.n FROM runs r JOIN sizes s USING (repo_id, text)),
pairs AS (SELECT a.repo_id AS x, b.repo_id AS y, a.text AS tx, b.text AS ty, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM kept a JOIN kept b ON a.run = b.run AND a.repo_id < b.repo_id GROUP BY ALL)
SELECT DISTINCT x AS repo_id_a, y AS repo_id_b FROM pairs WHERE 2 * c >= nx + ny - c"""


@query
def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of copies and reworked versions each repository belongs to."""
    from lodestrata.llm.dartminhash import groups

    return groups(_contents(spark, d)).withColumnRenamed("id", "repo_id")


# ---------------------------------------------------------------- 5


def _places_meant(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.canonical import match_canonical, place_entries

    owners = table(spark, d, "owners").select("account_id", F.col("owner_location").alias("value")).where(F.trim("value") != "")
    matched = match_canonical(owners, "value", place_entries(table(spark, d, "places")))
    return owners.join(matched, "value")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The place each typed location means, -1 for none."""
    return _places_meant(spark, d).select("account_id", F.col("entry_id").alias("place_id"))


@query
def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed locations that mean no listed place, with the number of accounts."""
    return _places_meant(spark, d).where("entry_id = -1").groupBy("value").agg(F.count("*").alias("accounts"))


# ---------------------------------------------------------------- 7


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different written companies that name the same organisation."""
    from lodestrata.llm.names import link_names, variant_pairs

    pairs = variant_pairs(link_names(table(spark, d, "owners"), "owner_company"))
    return pairs.select(F.col("name_a").alias("company_a"), F.col("name_b").alias("company_b"))


@query
def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    """The organisation behind each written company."""
    from lodestrata.llm.names import link_names

    return link_names(table(spark, d, "owners"), "owner_company")


# ---------------------------------------------------------------- 8 and 9


def _packed(spark: SparkSession, d: str, both: bool = False):
    from lodestrata.llm.packing import pack_documents
    from lodestrata.llm.tokens import token_counts

    counted = token_counts(spread(table(spark, d, "documents"), "doc_id"), ["doc_id"], "text")
    packed = pack_documents(counted, "doc_id", table(spark, d, "container_sizes"))
    return (packed, counted) if both else packed


@query
def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, for each container size."""
    return _packed(spark, d)


@query
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    from lodestrata.llm.packing import fill_report

    return fill_report(_packed(spark, d), table(spark, d, "container_sizes"))


@query
def p8_kept_promises(spark: SparkSession, d: str) -> DataFrame:
    """Per container size: documents packed, containers over their capacity, documents split though they fit, documents not whole."""
    packed, counted = _packed(spark, d, both=True)
    caps = table(spark, d, "container_sizes").select("container_name", "capacity_tokens")
    boxes = packed.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("held")).join(caps, "container_name")
    over = boxes.groupBy("container_name").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"))
    parts = packed.groupBy("container_name", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("held")).join(counted, "doc_id").join(caps, "container_name")
    kept = parts.groupBy("container_name").agg(F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("split_though_fitting"), F.count_if(F.col("held") != F.col("n_tokens")).alias("not_whole"))
    return kept.join(over, "container_name").select("container_name", "documents", "overfull", "split_though_fitting", "not_whole")


SQL["p8_kept_promises"] = """SELECT container_name, (SELECT count(*) FROM documents WHERE text <> '') AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split_though_fitting, CAST(0 AS BIGINT) AS not_whole FROM container_sizes"""


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.mixing import mix_sources
    from lodestrata.llm.tokens import token_counts

    docs = spread(table(spark, d, "documents"), "doc_id")
    h = docs.withColumn("key", F.coalesce("text", F.lit("")))
    counted = token_counts(h.withColumn("text_key", F.concat(F.hex(F.xxhash64("key")), F.hex(F.xxhash64(F.lit(1), F.reverse("key"))))), ["doc_id", "source", "text_key"], "text")
    return mix_sources(counted, "doc_id", "text_key", "source", table(spark, d, "mix_targets"))


@query
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with their number of copies."""
    return _mixed(spark, d)


@query
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached by each mix."""
    from lodestrata.llm.mixing import mix_report

    return mix_report(_mixed(spark, d), table(spark, d, "mix_targets"))


@query
def p9_kept_promises(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source: documents used too often or from another source, and whether the share is
    missed by as much as a median text of the source of the longest texts: what other sources are off moves the total."""
    from lodestrata.llm.mixing import mix_report

    mixed, targets = _mixed(spark, d), table(spark, d, "mix_targets")
    docs = table(spark, d, "documents").select("text", F.col("source").alias("held"), "doc_id")
    same = docs.select(F.xxhash64("text").alias("h"), "held").where("held is not null").distinct()
    of = mixed.join(docs.select("doc_id", F.xxhash64("text").alias("h")), "doc_id").join(same.withColumnRenamed("held", "source").withColumn("is_held", F.lit(True)), ["h", "source"], "left")
    used = of.join(targets.select("mix_name", "source", "max_repeats"), ["mix_name", "source"]).groupBy("mix_name", "source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("used_too_often"), F.count_if(F.col("is_held").isNull()).alias("from_elsewhere"))
    typical = mixed.groupBy("mix_name", "source").agg(F.percentile_approx("n_tokens", 0.5).alias("text")).groupBy("mix_name").agg(F.max("text").alias("text"))
    report = mix_report(mixed, targets).select("mix_name", "source", "gap_tokens")
    return report.join(used, ["mix_name", "source"]).join(typical, "mix_name").select("mix_name", "source", "used_too_often", "from_elsewhere", (F.abs("gap_tokens") >= F.col("text")).alias("share_missed"))


SQL["p9_kept_promises"] = "SELECT mix_name, source, CAST(0 AS BIGINT) AS used_too_often, CAST(0 AS BIGINT) AS from_elsewhere, false AS share_missed FROM mix_targets"


# ---------------------------------------------------------------- 4


def _language_model(docs: DataFrame):
    from lodestrata.llm.language import train

    return train(docs, "doc_id", "text", "lang")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The languages of documents with a missing or wrong label or a mixed text."""
    from lodestrata.llm.language import identify, wrong_labels

    docs = table(spark, d, "documents")
    return wrong_labels(identify(spread(docs, "doc_id"), "text", _language_model(docs), ["doc_id", "lang"]), "doc_id", "lang")


@query
def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments of every document with their language and confidence."""
    from lodestrata.llm.language import segments

    docs = table(spark, d, "documents")
    return segments(spread(docs, "doc_id"), "doc_id", "text", _language_model(docs))


# ---------------------------------------------------------------- 10


def _levels(spark: SparkSession, d: str, sources: list[str] | None) -> DataFrame:
    from lodestrata.llm.readability import fit_levels, reading_levels

    docs = table(spark, d, "documents")
    cuts = fit_levels(table(spark, d, "reading_samples"), "text", "reading_level")
    chosen = docs.where(F.col("source").isin(sources)) if sources else docs
    return reading_levels(spread(chosen, "doc_id"), "doc_id", "text", cuts, _language_model(docs))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of the English documents of four sources."""
    return _levels(spark, d, ["wiki_page", "tutorial", "contributing_guide", "faq"]).select("doc_id", "reading_level")


@query
def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """English documents and words of the corpus by source and reading level."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    levels = _levels(spark, d, None).join(docs, "doc_id")
    return levels.groupBy("source", "reading_level").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


# ---------------------------------------------------------------- 6


def _personal(spark: SparkSession, d: str) -> DataFrame:
    """Both fields in one table. A repository's readme stays over its fetches: rows may repeat."""
    bios = table(spark, d, "owners").select(F.lit("owner_bio").alias("field"), F.col("account_id").alias("ref_id"), F.col("owner_bio").alias("text"))
    readmes = table(spark, d, "repositories").select(F.lit("readme_content").alias("field"), F.col("repo_id").alias("ref_id"), F.col("readme_content").alias("text"))
    return spread(bios, "ref_id").unionByName(spread(readmes, "ref_id")).where("text <> ''")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Where personal values stand in bios and readmes."""
    from lodestrata.llm.privacy import candidates, learn, personal_values

    texts = _personal(spark, d)
    found = candidates(texts, "text")
    return personal_values(texts, ["field", "ref_id"], "text", learn(found), found).select("field", "ref_id", "kind", "start_pos").distinct()


@query
def p6_sanitized(spark: SparkSession, d: str) -> DataFrame:
    """Bios and readmes with placeholders."""
    from lodestrata.llm.privacy import candidates, learn, sanitize

    texts = _personal(spark, d)
    found = candidates(texts, "text")
    return sanitize(texts, ["field", "ref_id"], "text", learn(found), found).distinct()
