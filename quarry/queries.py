"""The registered queries of the core: each a plan over the catalogue tables, with the SQL that states the same beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import scalar as s
from quarry.operators import catalogue as c
from quarry.operators import evaluation as e
from quarry.operators import features, frames
from quarry.operators import reports as r
from quarry.operators.filters import Filters, allowed, browse, located
from quarry.operators.fusion import explained, fused, top
from quarry.operators.incremental import work_since
from quarry.operators.keyword import KeywordIndex, bm25, documents
from quarry.operators.signals import best_per_asset, best_per_asset_many, finished_vectors, zscored
from quarry.plans.search import HybridSearcher, Response
from quarry.session import scratch, ship
from quarry.tables import table as t

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The search the examples run: its text, and the row of eval_queries that embeds it.
TEXT, ROW = "images showing the sharp catalogue", 1
NOW, SIGNATURE = 1_760_000_000.0, "v1|halo-s16|web2b|quill-mini|cap-small|asr-tiny"
ROOT = "docs"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, d: (ship(spark), f(spark, d))[1]
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# scans and scalars -----------------------------------------------------------------------------------------------------------------

_IN = lambda values: ", ".join(f"'{v}'" for v in values)
_KIND = f"CASE WHEN lower(ext) IN ({_IN(s.IMAGE)}) THEN 'image' WHEN lower(ext) IN ({_IN(s.VIDEO)}) THEN 'video' WHEN lower(ext) IN ({_IN(s.PDF)}) THEN 'pdf' END"


@query(f"SELECT id, {_KIND} AS found_kind FROM files")
def kind_by_ending(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "files").select("id", s.kind_for_ext(F.col("ext")).alias("found_kind"))


@query("SELECT hash, sha256(body) AS body_hash FROM assets WHERE body IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "assets").where("body is not null").select("hash", F.sha2("body", 256).alias("body_hash"))


@query("SELECT v.id FROM vectors v WHERE space = 'clip' AND hash IN (SELECT hash FROM assets WHERE status = 'done')")
def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    return finished_vectors(t(spark, d, "vectors"), t(spark, d, "assets"), "clip").select("id")


@query("SELECT id, path, size, hash FROM files WHERE id = 7")
def lookup_file(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "files").where(F.col("id") == 7).select("id", "path", "size", "hash")


@query("SELECT key, value FROM meta WHERE key = 'model_sig'")
def lookup_meta(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "meta").where(F.col("key") == "model_sig").select("key", "value")


@query(r"""SELECT hash, substr(body, 1, 4000) AS body, len(tags) AS n_tags, meta.width AS width, meta.pages AS pages FROM assets WHERE status = 'done'""")
def asset_detail(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "assets").where("status = 'done'").select("hash", F.substring("body", 1, 4000).alias("body"), F.when(F.col("tags").isNotNull(), F.size("tags")).cast("long").alias("n_tags"), F.col("meta.width").alias("width"), F.col("meta.pages").alias("pages"))


@query("SELECT id, ref, source FROM vectors WHERE hash = (SELECT min(hash) FROM assets WHERE kind = 'pdf' AND status = 'done') ORDER BY ref NULLS FIRST, id")
def asset_parts(spark: SparkSession, d: str) -> DataFrame:
    one = t(spark, d, "assets").where("kind = 'pdf' and status = 'done'").agg(F.min("hash").alias("hash"))
    return t(spark, d, "vectors").join(F.broadcast(one), "hash").select("id", "ref", "source").orderBy(F.col("ref").asc_nulls_first(), "id")


_DETECT = " ".join(f"WHEN regexp_matches(query, '\\b({w})\\b', 'i') THEN '{k}'" for k, w in s.KIND_WORDS.items())
_STRIP = " ".join(f"WHEN kind = '{k}' THEN regexp_replace(query, '\\b({w})\\b', ' ', 'gi')" for k, w in s.KIND_WORDS.items())
_PARSED = f"""
    parsed AS (SELECT id, query, kind, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS plain,
        trim(regexp_replace(CASE WHEN kind IS NULL THEN query ELSE
            regexp_replace(CASE {_STRIP} ELSE query END, '^\\s*(?:\\b(?:{s.OPENERS})\\b\\s*)+', ' ', 'i') END, '\\s+', ' ', 'g'), ' ,.-') AS tidy
        FROM (SELECT id, query, CASE {_DETECT} END AS kind FROM eval_queries))"""


@query(f"WITH {_PARSED} SELECT id, kind AS found_kind, CASE WHEN tidy = '' THEN plain ELSE tidy END AS clean FROM parsed")
def parse_query(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return t(spark, d, "eval_queries").select("id", s.detected_kind(q).alias("found_kind"), s.cleaned_query(q).alias("clean"))


@query(f"""SELECT id, array_to_string(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: w NOT IN ({_IN(s.STOP)}) AND length(w) > 1)[1:12], ' ') AS terms FROM eval_queries""")
def keyword_terms(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "eval_queries").select("id", F.array_join(s.query_terms(F.col("query")), " ").alias("terms"))


_CHUNKS = r"list_filter(list_transform(regexp_extract_all(trim(regexp_replace(body, '\s+', ' ', 'g')), '(?s)(.{1,900}\z|.{451,899} |.{900})', 1), lambda c: trim(c)), lambda c: length(c) > 20)"


@query(f"SELECT hash, n, chunk FROM (SELECT hash, unnest(k) AS chunk, generate_subscripts(k, 1) AS n FROM (SELECT hash, {_CHUNKS} AS k FROM assets WHERE body IS NOT NULL))")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "assets").where("body is not null").select("hash", F.posexplode(s.chunks(F.col("body"), 900)).alias("n", "chunk")).select("hash", (F.col("n") + 1).cast("long").alias("n"), "chunk")


@query(r"""SELECT hash, substr(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: length(x) > 3)[1], 1, 120) AS title FROM assets WHERE kind = 'pdf' AND body IS NOT NULL""")
def pdf_title(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "assets").where("kind = 'pdf' and body is not null").select("hash", s.first_line(F.col("body")).alias("title"))


@query(r"""SELECT hash, trim(concat(coalesce(meta.title, ''), '. ', substr(trim(regexp_replace(coalesce(body, ''), '\s+', ' ', 'g')), 1, 600)), '. ') AS summary FROM assets WHERE kind = 'pdf'""")
def pdf_summary_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "assets").where("kind = 'pdf'").select("hash", s.summary_text(F.col("meta.title"), F.col("body")).alias("summary"))


@query(r"""SELECT hash, string_agg(w, ' ' ORDER BY id) AS filenames FROM (SELECT hash, id, translate(regexp_replace(filename, '\.[^.]*$', ''), '_-', '  ') AS w FROM files WHERE present AND hash IS NOT NULL) GROUP BY hash""")
def filenames_field(spark: SparkSession, d: str) -> DataFrame:
    return c.search_texts(t(spark, d, "files"))


@query("""SELECT id, CASE WHEN size < 1024 THEN size::VARCHAR || ' B' WHEN size < 1048576 THEN printf('%.1f', size / 1024.0) || ' KB' WHEN size < 1073741824 THEN printf('%.1f', size / 1048576.0) || ' MB'
    ELSE printf('%.1f', size / 1073741824.0) || ' GB' END AS shown FROM files WHERE size IS NOT NULL AND size < 1099511627776""")
def size_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "files").where(f"size is not null and size < {1 << 40}").select("id", s.bytes_text(F.col("size")).alias("shown"))


@query("""SELECT v.id, CASE WHEN source = 'frame' AND ref IS NOT NULL THEN '▶ ' || (floor(ref)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(ref)::BIGINT % 60)::VARCHAR, 2, '0')
    WHEN source = 'transcript' THEN '🗣 speech' WHEN kind = 'pdf' AND ref IS NOT NULL THEN 'page ' || trunc(ref)::BIGINT::VARCHAR ELSE '' END AS shown FROM vectors v JOIN assets a USING (hash)""")
def match_place(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "vectors").join(t(spark, d, "assets").select("hash", "kind"), "hash").select("id", s.where_label(F.col("source"), F.col("ref"), F.col("kind")).alias("shown"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS first FROM embeddings")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = t(spark, d, "embeddings").select("vec_id", F.sqrt(s.dot(F.col("embedding"), F.col("embedding"))).alias("n"), s.unit(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round("n", 4).alias("norm"), F.round(F.col("u")[0], 4).alias("first"))


@query("SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def json_sum(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


# filters ---------------------------------------------------------------------------------------------------------------------------

_LOCATED = "located AS (SELECT f.id AS file_id, f.hash, f.path, f.filename, f.folder, f.ext, f.size, f.mtime, a.kind AS asset_kind, a.meta, a.caption FROM files f JOIN assets a ON f.hash = a.hash WHERE f.present AND a.status = 'done')"


def _filter(name: str, sql: str, filters: Filters) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return allowed(t(spark, d, "assets"), t(spark, d, "files"), filters).select("hash", "file_id", F.size("duplicates").cast("long").alias("copies"))

    run.__name__ = name
    query(f"WITH {_LOCATED} SELECT hash, arg_min(file_id, (folder, filename, file_id)) AS file_id, count(*) - 1 AS copies FROM located WHERE {sql} GROUP BY hash")(run)


_filter("filter_none", "true", Filters())
_filter("filter_kinds", "asset_kind IN ('image', 'pdf')", Filters(kinds=("image", "pdf")))
_filter("filter_size_range", "size >= 0.5 * 1048576 AND size <= 4 * 1048576", Filters(min_mb=0.5, max_mb=4))
_filter("filter_folder_like", "translate(folder, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%do_s%'", Filters(folder="DO_S"))
_filter("filter_ending", "ext = '.jpg'", Filters(ext="..JPG"))
_filter("filter_modified_after", "mtime >= 1700000000", Filters(modified_after=1_700_000_000))
_filter("filter_orientation", "CASE WHEN asset_kind IN ('image', 'video') THEN coalesce(meta.width, 0) > coalesce(meta.height, 0) ELSE true END", Filters(orientation="landscape"))
_filter("filter_duration", "CASE WHEN asset_kind = 'video' THEN coalesce(meta.duration, 0) <= 30 ELSE true END", Filters(max_duration=30))
_filter("filter_speech", "CASE WHEN asset_kind = 'video' THEN coalesce(meta.has_speech, false) ELSE true END", Filters(has_speech=True))


@query(f"""WITH {_LOCATED}, n AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY folder, filename, file_id) AS k FROM located)
    SELECT hash, max(path) FILTER (k = 1) AS path, coalesce(string_agg(path, '|' ORDER BY k) FILTER (k > 1), '') AS others FROM n GROUP BY hash""")
def representative_and_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return allowed(t(spark, d, "assets"), t(spark, d, "files")).select("hash", "path", F.array_join("duplicates.path", "|").alias("others"))


@query(f"WITH {_LOCATED} SELECT hash, arg_min(file_id, (folder, filename, file_id)) AS file_id, arg_min(mtime, (folder, filename, file_id)) AS mtime FROM located GROUP BY hash ORDER BY 3 DESC, min((folder, filename)) LIMIT 24")
def browse_latest(spark: SparkSession, d: str) -> DataFrame:
    return browse(allowed(t(spark, d, "assets"), t(spark, d, "files"))).select("hash", "file_id", "mtime")


@query(f"WITH {_LOCATED} SELECT count(*) AS total FROM (SELECT DISTINCT hash FROM located)")
def browse_total(spark: SparkSession, d: str) -> DataFrame:
    return HybridSearcher(t(spark, d, "assets"), t(spark, d, "files"), t(spark, d, "vectors")).search("  ").candidates.agg(F.count("*").alias("total"))


# signals ---------------------------------------------------------------------------------------------------------------------------


def _sims(space: str) -> str:
    return f"""
    {space}_q AS (SELECT {space}_vec::DOUBLE[] AS q FROM eval_queries WHERE id = {ROW}),
    {space}_sim AS (SELECT id, hash, source, ref, label, sim FROM (SELECT v.id, v.hash, v.source, v.ref, v.label, CASE WHEN len(vec) = len(q) THEN list_dot_product(vec::DOUBLE[], q) END AS sim
        FROM vectors v, {space}_q WHERE space = '{space}' AND hash IN (SELECT hash FROM assets WHERE status = 'done')) WHERE sim IS NOT NULL AND NOT isnan(sim)),
    {space}_best AS (SELECT hash, max(sim) AS best, arg_max(id, (sim, -id)) AS vec_id, arg_max(source, (sim, -id)) AS source,
        arg_max(coalesce(ref, -1), (sim, -id)) AS ref, arg_max(sim, id) FILTER (source = 'pdf_summary') AS summary FROM {space}_sim GROUP BY hash),
    {space}_signal AS (SELECT hash, CASE WHEN summary IS NULL THEN best ELSE 0.5 * best + 0.5 * summary END AS score, vec_id, source, ref FROM {space}_best),
    {space}_stats AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM {space}_signal),
    {space}_z AS (SELECT hash, score, vec_id, source, ref, (score - mu) / CASE WHEN sd > 1e-6 THEN sd ELSE 1 END AS z FROM {space}_signal, {space}_stats)"""


def _signal(spark: SparkSession, d: str, space: str) -> DataFrame:
    q = t(spark, d, "eval_queries").where(F.col("id") == ROW).first()[f"{space}_vec"]
    return best_per_asset(finished_vectors(t(spark, d, "vectors"), t(spark, d, "assets"), space), q)


@query(f"WITH {_sims('clip')} SELECT hash, round(score, 4) AS score, vec_id FROM clip_signal")
def max_sim_per_asset(spark: SparkSession, d: str) -> DataFrame:
    return _signal(spark, d, "clip").select("hash", F.round("score", 4).alias("score"), F.col("match.id").alias("vec_id"))


@query(f"WITH {_sims('text')} SELECT hash, round(score, 4) AS score, vec_id, source FROM text_signal")
def summary_blend(spark: SparkSession, d: str) -> DataFrame:
    return _signal(spark, d, "text").select("hash", F.round("score", 4).alias("score"), F.col("match.id").alias("vec_id"), F.col("match.source").alias("source"))


@query(f"WITH {_sims('text')} SELECT hash, round(z, 4) AS z FROM text_z")
def zscore_signal(spark: SparkSession, d: str) -> DataFrame:
    return zscored(_signal(spark, d, "text")).select("hash", F.round("z", 4).alias("z"))


@query("""WITH s AS (SELECT e.id AS query_id, v.hash, v.id, v.source, CASE WHEN len(v.vec) = 64 THEN list_dot_product(v.vec::DOUBLE[], e.text_vec::DOUBLE[]) END AS sim
        FROM vectors v, eval_queries e WHERE v.space = 'text' AND v.hash IN (SELECT hash FROM assets WHERE status = 'done')),
    b AS (SELECT query_id, hash, max(sim) AS best, arg_max(id, (sim, -id)) AS vec_id, arg_max(sim, id) FILTER (source = 'pdf_summary') AS summary FROM s WHERE sim IS NOT NULL AND NOT isnan(sim) GROUP BY ALL)
    SELECT query_id, hash, round(CASE WHEN summary IS NULL THEN best ELSE 0.5 * best + 0.5 * summary END, 4) AS score, vec_id FROM b""")
def all_query_signals(spark: SparkSession, d: str) -> DataFrame:
    q = [(x["id"], x["text_vec"]) for x in t(spark, d, "eval_queries").select("id", "text_vec").collect()]
    found = best_per_asset_many(finished_vectors(t(spark, d, "vectors"), t(spark, d, "assets"), "text"), q)
    return found.select("query_id", "hash", F.round("score", 4).alias("score"), "vec_id")


# keywords --------------------------------------------------------------------------------------------------------------------------

_TERMS = ["sharp", "catalogue"]
_FROM, _TO = s.accents()
_TOKENS = lambda x: f"regexp_extract_all(translate(lower({x}), '{_FROM}', '{_TO}'), '[\\p{{L}}\\p{{N}}]+')"


def _bm25(weights: dict[str, float], terms: list[str]) -> str:
    text = {"filenames": "coalesce(n.names, '')", "caption": "coalesce(a.caption, '')", "tags": "coalesce(array_to_string(a.tags, ' '), '')", "body": "coalesce(a.body, '')"}
    tf = ", ".join("(" + " + ".join(f"{w!r}::DOUBLE * len(list_filter({f}, lambda x: x = '{x}'))" for f, w in weights.items()) + f") AS f{i}" for i, x in enumerate(terms))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))" for i in range(len(terms)))
    return f"""
    names AS (SELECT hash, string_agg(translate(regexp_replace(filename, '\\.[^.]*$', ''), '_-', '  '), ' ' ORDER BY id) AS names FROM files WHERE present AND hash IS NOT NULL GROUP BY hash),
    tokens AS (SELECT a.hash, {", ".join(f"{_TOKENS(text[f])} AS {f}" for f in weights)} FROM assets a LEFT JOIN names n ON a.hash = n.hash),
    counted AS (SELECT hash, {" + ".join(f"len({f})" for f in weights)} AS dl, {tf} FROM tokens),
    stats AS (SELECT count(*) AS n, avg(dl) AS mean, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))} FROM counted),
    bm AS (SELECT hash, {score} AS bm25 FROM counted, stats WHERE {" OR ".join(f"f{i} > 0" for i in range(len(terms)))}),
    kw AS (SELECT hash, bm25, bm25 / (SELECT max(bm25) FROM bm) AS keyword FROM bm)"""


_EVEN = {"filenames": 1.0, "caption": 1.0, "tags": 1.0, "body": 1.0}
_FIELDS = {"filenames": 0.3, "caption": 1.0, "tags": 0.8, "body": 0.6}


@query(f"WITH {_bm25(_EVEN, _TERMS)} SELECT hash, round(bm25, 4) AS bm25 FROM kw")
def bm25_or(spark: SparkSession, d: str) -> DataFrame:
    return bm25(documents(t(spark, d, "assets"), t(spark, d, "files")), _TERMS, _EVEN).select("hash", F.round("bm25", 4).alias("bm25"))


@query(f"WITH {_bm25(_FIELDS, _TERMS)} SELECT hash, round(bm25, 4) AS bm25 FROM kw")
def bm25_field_weighted(spark: SparkSession, d: str) -> DataFrame:
    return bm25(documents(t(spark, d, "assets"), t(spark, d, "files")), _TERMS).select("hash", F.round("bm25", 4).alias("bm25"))


@query(f"WITH {_bm25(_FIELDS, _TERMS)} SELECT hash, round(keyword, 4) AS keyword FROM kw")
def bm25_normalised(spark: SparkSession, d: str) -> DataFrame:
    return bm25(documents(t(spark, d, "assets"), t(spark, d, "files")), _TERMS).select("hash", F.round("keyword", 4).alias("keyword"))


@query(f"WITH {_bm25(_FIELDS, _TERMS)} SELECT hash, round(bm25, 4) AS bm25 FROM kw")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same from postings."""
    index = KeywordIndex(documents(t(spark, d, "assets"), t(spark, d, "files")), scratch(spark, "postings"))
    return index.search(_TERMS).select("hash", F.round("bm25", 4).alias("bm25"))


@query()
def bm25_porter(spark: SparkSession, d: str) -> DataFrame:
    return bm25(documents(t(spark, d, "assets"), t(spark, d, "files")), _TERMS, stems=True).select("hash", F.round("bm25", 4).alias("bm25"))


# fusion ----------------------------------------------------------------------------------------------------------------------------


def _fusion(intent: str | None) -> str:
    boost = f"+ CASE WHEN kind = '{intent}' THEN 1.5::DOUBLE ELSE -0.5::DOUBLE END" if intent else ""
    weight = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN {w[i]}::DOUBLE" for k, w in {"image": (0.60, 0.40), "video": (0.55, 0.45), "pdf": (0.25, 0.75)}.items()) + " ELSE 0.5::DOUBLE END"
    return f"""WITH {_LOCATED}, {_sims('clip')}, {_sims('text')}, {_bm25(_FIELDS, _TERMS)},
    allowed AS (SELECT hash, any_value(asset_kind) AS kind, min((folder, filename, file_id)) AS place FROM located GROUP BY hash),
    joined AS (SELECT a.hash, a.kind, a.place, v.z AS zv, x.z AS zs, k.keyword, v.score AS visual, x.score AS semantic, v.source AS v_source, x.source AS x_source, v.ref AS v_ref, x.ref AS x_ref, v.vec_id AS v_id, x.vec_id AS x_id
        FROM allowed a LEFT JOIN clip_z v ON a.hash = v.hash LEFT JOIN text_z x ON a.hash = x.hash LEFT JOIN kw k ON a.hash = k.hash),
    scored AS (SELECT *, CASE WHEN zv IS NOT NULL AND zs IS NULL THEN 1::DOUBLE WHEN zs IS NOT NULL AND zv IS NULL THEN 0::DOUBLE ELSE {weight(0)} END * coalesce(zv, 0)
        + CASE WHEN zs IS NOT NULL AND zv IS NULL THEN 1::DOUBLE WHEN zv IS NOT NULL AND zs IS NULL THEN 0::DOUBLE ELSE {weight(1)} END * coalesce(zs, 0) + 0.35::DOUBLE * coalesce(keyword, 0) {boost} AS raw
        FROM joined WHERE coalesce(zv, zs, keyword) IS NOT NULL),
    final AS (SELECT *, round(raw, 3) AS score, round(100 / (1 + exp(-1.6::DOUBLE * (raw - 1.2::DOUBLE))), 1) AS relevance,
        x_id IS NOT NULL AND (v_id IS NULL OR kind = 'pdf' OR (x_source = 'transcript' AND semantic > 0.45)) AS by_text FROM scored)"""


_SEARCHERS: dict[tuple, HybridSearcher] = {}


def _searcher(spark: SparkSession, d: str, stems: bool) -> HybridSearcher:
    """A searcher of the catalogue, kept with its vectors and postings as long as the catalogue's version stays."""
    version = t(spark, d, "meta").where(F.col("key") == "vectors_version").first()["value"]
    own = (spark.sparkContext.applicationId, d, stems)
    if own not in _SEARCHERS:
        _SEARCHERS[own] = HybridSearcher(t(spark, d, "assets"), t(spark, d, "files"), t(spark, d, "vectors"), stems=stems)
    _SEARCHERS[own].keep_fresh(version, lambda: t(spark, d, "vectors"), scratch(spark, "postings"))
    return _SEARCHERS[own]


def _searched(spark: SparkSession, d: str, filters: Filters | None = None, stems: bool = False):
    q = t(spark, d, "eval_queries").where(F.col("id") == ROW).first()
    return _whole(_searcher(spark, d, stems).search(TEXT, filters, 24, q["clip_vec"], q["text_vec"]))


def _whole(response: Response) -> Response:
    """A registered query has all its signals; what a search would warn of is an error here."""
    if response.warnings:
        raise RuntimeError("; ".join(response.warnings))
    return response


@query(_fusion("image") + " SELECT hash, kind, score, relevance, CASE WHEN score >= 2 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM final ORDER BY score DESC, place LIMIT 24")
def fused_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d).results.select("hash", "kind", "score", "relevance", "confidence")


@query()
def fused_ranking_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, stems=True).results.select("hash", "kind", "score", "relevance", "confidence")


@query(_fusion("image") + " SELECT hash, kind, score, relevance, CASE WHEN score >= 2 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM final ORDER BY score DESC, place LIMIT 24")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship search again: what a searcher keeps serves every search until the catalogue's version changes."""
    return _searched(spark, d).results.select("hash", "kind", "score", "relevance", "confidence")


@query(_fusion("image") + " SELECT hash, kind, score, relevance, CASE WHEN score >= 2 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM final ORDER BY score DESC, place LIMIT 24")
def unindexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The same search without anything kept: every text is cut into words."""
    q = t(spark, d, "eval_queries").where(F.col("id") == ROW).first()
    searcher = HybridSearcher(t(spark, d, "assets"), t(spark, d, "files"), t(spark, d, "vectors"), stems=False)
    return _whole(searcher.search(TEXT, None, 24, q["clip_vec"], q["text_vec"])).results.select("hash", "kind", "score", "relevance", "confidence")


@query(_fusion("image") + " SELECT kind, count(*) AS n, round(avg(score), 3) AS mean_score, max(score) AS best FROM final GROUP BY kind")
def intent_boost(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d).candidates.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean_score"), F.max("score").alias("best"))


@query(_fusion(None) + " SELECT hash, score FROM final WHERE kind IN ('pdf', 'video') ORDER BY score DESC, place LIMIT 24")
def kinds_filter_overrides_intent(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, Filters(kinds=("pdf", "video"))).results.select("hash", "score")


@query(_fusion("image") + " SELECT CASE WHEN score >= 2 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM final GROUP BY 1")
def confidence_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d).candidates.groupBy("confidence").agg(F.count("*").alias("n"))


@query(_fusion("image") + " SELECT hash, CASE WHEN by_text THEN x_id ELSE v_id END AS vec_id, CASE WHEN by_text THEN x_source ELSE v_source END AS source FROM final")
def explain_best_match(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d).candidates.select("hash", F.col("best_match.id").alias("vec_id"), F.col("best_match.source").alias("source"))


@query(_fusion("image") + " SELECT count(*) AS total_candidates FROM final")
def total_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d).candidates.agg(F.count("*").alias("total_candidates"))


@query(_fusion("image") + " SELECT hash, round(visual, 3) AS visual, round(semantic, 3) AS semantic, round(coalesce(keyword, 0), 3) AS keyword FROM final")
def signal_values(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d).candidates.select("hash", F.round("visual", 3).alias("visual"), F.round("semantic", 3).alias("semantic"), F.round(F.coalesce("keyword", F.lit(0.0)), 3).alias("keyword"))


@query("""WITH z AS (SELECT vec_id AS hash, label, embedding[1]::DOUBLE AS score FROM embeddings), s AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM z)
    SELECT hash, round((score - mu) / CASE WHEN sd > 1e-6 THEN sd ELSE 1 END, 4) AS z FROM z, s""")
def zscore_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return zscored(t(spark, d, "embeddings").select(F.col("vec_id").alias("hash"), F.col("embedding")[0].cast("double").alias("score"))).select("hash", F.round("z", 4).alias("z"))


# reports ---------------------------------------------------------------------------------------------------------------------------

_HAS = "EXISTS (SELECT 1 FROM files f WHERE f.hash = a.hash AND f.present)"


@query("SELECT kind, count(*) AS files, sum(size)::BIGINT AS bytes, count(DISTINCT hash) AS unique_assets FROM files WHERE present AND file_status = 'ok' GROUP BY kind")
def stats_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return r.by_kind(t(spark, d, "files"))


@query("SELECT kind, count(*) AS files, sum(size)::BIGINT AS bytes, grouping(kind) = 1 AS is_total FROM files WHERE present AND file_status = 'ok' GROUP BY ROLLUP (kind)")
def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    return r.totals(t(spark, d, "files"))


@query("SELECT coalesce(sum(c - 1), 0)::BIGINT AS duplicate_files FROM (SELECT count(*) AS c FROM files WHERE present AND hash IS NOT NULL GROUP BY hash HAVING count(*) > 1)")
def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    return r.duplicate_files(t(spark, d, "files"))


@query("SELECT file_status, count(*) AS n, sum(size)::BIGINT AS bytes FROM files WHERE present AND file_status <> 'ok' GROUP BY 1")
def stats_skipped(spark: SparkSession, d: str) -> DataFrame:
    return r.skipped_by_status(t(spark, d, "files"))


@query("SELECT file_status, ext, count(*) AS n, sum(size)::BIGINT AS bytes FROM files WHERE present AND file_status <> 'ok' GROUP BY 1, 2")
def stats_skipped_by_ending(spark: SparkSession, d: str) -> DataFrame:
    return r.skipped_by_status(t(spark, d, "files"), "ext")


@query("SELECT space, source, count(*) AS n FROM vectors GROUP BY 1, 2")
def stats_vectors(spark: SparkSession, d: str) -> DataFrame:
    return r.vector_counts(t(spark, d, "vectors"))


@query("SELECT kind, count(*) AS n, round(avg(process_ms), 4) AS avg_ms, sum(process_ms)::BIGINT AS total_ms FROM assets WHERE status = 'done' GROUP BY kind")
def stats_timing(spark: SparkSession, d: str) -> DataFrame:
    return r.timing(t(spark, d, "assets")).withColumn("avg_ms", F.round("avg_ms", 4))


@query(f"SELECT kind, status, count(*) AS n, round(avg(process_ms)) AS ms FROM assets a WHERE {_HAS} GROUP BY 1, 2")
def stats_status_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return r.status_by_kind(t(spark, d, "assets"), t(spark, d, "files"))


@query(f"SELECT status, count(*) AS n FROM assets a WHERE {_HAS} GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return r.status_counts(t(spark, d, "assets"), t(spark, d, "files"))


@query("""SELECT count(*) FILTER (kind = 'video') AS videos, round(sum(meta.duration) FILTER (kind = 'video'), 4) AS seconds, (sum(meta.frames_sampled) FILTER (kind = 'video'))::BIGINT AS frames,
    (sum(meta.has_speech::BIGINT) FILTER (kind = 'video'))::BIGINT AS with_speech, (sum(meta.pages) FILTER (kind = 'pdf'))::BIGINT AS pages FROM assets WHERE status = 'done'""")
def media_totals(spark: SparkSession, d: str) -> DataFrame:
    return r.media_totals(t(spark, d, "assets")).withColumn("seconds", F.round("seconds", 4))


_FIRST = "first_path AS (SELECT hash, arg_min(path, id) AS path FROM files WHERE hash IS NOT NULL GROUP BY hash), first_present AS (SELECT hash, arg_min(path, id) AS path FROM files WHERE hash IS NOT NULL AND present GROUP BY hash)"


@query(f"WITH {_FIRST} SELECT a.hash, kind, error, attempts, processed_at, path FROM assets a JOIN first_present p ON a.hash = p.hash WHERE status = 'failed'")
def failures_report(spark: SparkSession, d: str) -> DataFrame:
    return r.failures(t(spark, d, "assets"), t(spark, d, "files"))


@query("SELECT id, path, ext, size, file_status, file_error FROM files WHERE present AND file_status <> 'ok' ORDER BY path")
def skipped_report(spark: SparkSession, d: str) -> DataFrame:
    return r.skipped(t(spark, d, "files"))


@query(f"WITH {_FIRST} SELECT a.hash, kind, array_to_string(warnings, '; ') AS warnings, path FROM assets a LEFT JOIN first_path p ON a.hash = p.hash WHERE status = 'done' AND len(warnings) > 0")
def warnings_report(spark: SparkSession, d: str) -> DataFrame:
    return r.warned(t(spark, d, "assets"), t(spark, d, "files")).withColumn("warnings", F.array_join("warnings", "; "))


@query(f"""WITH {_FIRST} SELECT * FROM (SELECT 'failed' AS state, path, error AS detail FROM assets a JOIN first_present p ON a.hash = p.hash WHERE status = 'failed')
    UNION ALL SELECT file_status, path, file_error FROM files WHERE present AND file_status <> 'ok'
    UNION ALL SELECT * FROM (SELECT 'warning', path, array_to_string(warnings, '; ') AS w FROM assets a LEFT JOIN first_path p ON a.hash = p.hash WHERE status = 'done' AND len(warnings) > 0 ORDER BY path NULLS FIRST, w LIMIT 50)""")
def problem_list(spark: SparkSession, d: str) -> DataFrame:
    return r.problems(t(spark, d, "assets"), t(spark, d, "files"))


@query("SELECT DISTINCT folder FROM files WHERE present ORDER BY folder")
def distinct_folders(spark: SparkSession, d: str) -> DataFrame:
    return r.folders(t(spark, d, "files"))


# the catalogue's changes ------------------------------------------------------------------------------------------------------------

_NEWEST = "newest AS (SELECT path, unnest(max(struct_pack(listed_at := listed_at, mtime := mtime, size := size, folder := folder, filename := filename, ext := ext))) FROM listing WHERE path IS NOT NULL GROUP BY path)"
_SAME = "(n.size = f.size AND abs(n.mtime - f.mtime) < 0.001 AND (f.hash IS NOT NULL OR f.file_status <> 'ok'))"
_CHANGE = f"CASE WHEN n.path IS NOT NULL AND f.id IS NULL THEN 'new' WHEN n.path IS NOT NULL AND coalesce({_SAME}, false) THEN 'unchanged' WHEN n.path IS NOT NULL THEN 'changed' WHEN f.present THEN 'missing' ELSE 'gone' END"
_DIFF = f"{_NEWEST}, diff AS (SELECT coalesce(n.path, f.path) AS path, {_CHANGE} AS change, n.ext, n.size, n.mtime, f.id AS old_id, f.file_status AS old_status FROM newest n FULL OUTER JOIN files f ON n.path = f.path)"


@query(f"WITH {_NEWEST} SELECT path, size, mtime, listed_at FROM newest")
def newest_sightings(spark: SparkSession, d: str) -> DataFrame:
    return c.newest_sightings(t(spark, d, "listing")).select("path", "size", "mtime", "listed_at")


@query(f"WITH {_DIFF} SELECT path, change FROM diff")
def scan_diff(spark: SparkSession, d: str) -> DataFrame:
    return c.scan_diff(t(spark, d, "listing"), t(spark, d, "files")).select("path", "change")


@query(f"""WITH {_DIFF} SELECT count(*) FILTER (change IN ('new', 'changed', 'unchanged')) AS seen, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged,
    count(*) FILTER (change = 'missing') AS missing, count(*) FILTER ((change IN ('new', 'changed') AND {_KIND} IS NULL) OR (change = 'unchanged' AND old_status = 'unsupported')) AS unsupported,
    count(*) FILTER (change IN ('new', 'changed') AND {_KIND} IS NOT NULL AND (size = 0 OR size > 2048 * 1048576::BIGINT)) AS errors FROM diff""")
def scan_counters(spark: SparkSession, d: str) -> DataFrame:
    return c.scan_counters(c.scan_diff(t(spark, d, "listing"), t(spark, d, "files")))


@query(f"""WITH {_NEWEST} SELECT path, CASE WHEN {_KIND} IS NULL THEN 'unsupported' WHEN size = 0 THEN 'unreadable' WHEN size > 100 * 1048576 THEN 'too_large' ELSE 'ok' END AS status FROM newest""")
def status_cascade(spark: SparkSession, d: str) -> DataFrame:
    return c.newest_sightings(t(spark, d, "listing")).select("path", c.file_status(s.kind_for_ext(F.col("ext")), F.col("size"), F.lit(True), 100).alias("status"))


@query(f"""WITH {_DIFF}, hashed AS (SELECT *, sha256(path) AS h FROM diff), st AS (SELECT *, {_KIND} AS k, CASE WHEN {_KIND} IS NULL THEN 'unsupported' WHEN size = 0 THEN 'unreadable' WHEN size > 2048 * 1048576::BIGINT THEN 'too_large' ELSE 'ok' END AS s FROM hashed)
    SELECT st.path, coalesce(old_id, (SELECT max(id) FROM files) + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY st.path)) AS id,
    CASE WHEN change IN ('new', 'changed') THEN s ELSE f.file_status END AS file_status, CASE WHEN change IN ('new', 'changed') THEN CASE WHEN s = 'ok' THEN h END ELSE f.hash END AS hash,
    CASE WHEN change IN ('new', 'changed', 'unchanged') THEN true WHEN change = 'missing' THEN false ELSE f.present END AS present, coalesce(f.first_seen, {NOW!r}::DOUBLE) AS first_seen FROM st LEFT JOIN files f ON st.path = f.path""")
def next_files(spark: SparkSession, d: str) -> DataFrame:
    files = t(spark, d, "files")
    diff = c.scan_diff(t(spark, d, "listing"), files)
    hashes = t(spark, d, "listing").select("path").distinct().select("path", F.sha2("path", 256).alias("content_hash"))
    return c.next_files(diff, hashes, NOW).select("path", "id", "file_status", "hash", "present", "first_seen")


@query(f"SELECT id, path FROM files f WHERE present AND (path LIKE '{ROOT}/%' OR path = '{ROOT}') AND path NOT IN (SELECT path FROM listing WHERE path IS NOT NULL)")
def missing_sweep(spark: SparkSession, d: str) -> DataFrame:
    return c.missing_sweep(t(spark, d, "files"), t(spark, d, "listing"), ROOT)


_OPEN = f"(status IN ('pending', 'processing') OR (status = 'failed' AND attempts < 3) OR (status = 'done' AND (model_sig IS NULL OR model_sig <> '{SIGNATURE}')))"


@query(f"SELECT hash, kind, size, CASE kind WHEN 'image' THEN 0 WHEN 'pdf' THEN 1 WHEN 'video' THEN 2 ELSE 9 END AS place FROM assets a WHERE {_HAS} AND {_OPEN} ORDER BY place, size, hash")
def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    return c.pending_queue(t(spark, d, "assets"), t(spark, d, "files"), SIGNATURE)


@query("SELECT hash, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status FROM assets")
def crash_recovery(spark: SparkSession, d: str) -> DataFrame:
    return c.recovered(t(spark, d, "assets")).select("hash", "status")


@query("SELECT hash, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM assets")
def retry_failed(spark: SparkSession, d: str) -> DataFrame:
    return c.retried(t(spark, d, "assets")).select("hash", "status", "attempts")


@query("SELECT hash, CASE WHEN status = 'pending' THEN 'processing' ELSE status END AS status, CASE WHEN status = 'pending' THEN coalesce(attempts, 0) + 1 ELSE attempts END AS attempts FROM assets")
def start_attempt(spark: SparkSession, d: str) -> DataFrame:
    assets = t(spark, d, "assets")
    return c.started(assets, assets.where("status = 'pending'")).select("hash", "status", "attempts")


@query(f"""SELECT hash, CASE WHEN status <> 'processing' AND status <> 'pending' THEN status WHEN size % 2 = 0 THEN 'done' ELSE 'failed' END AS status,
    CASE WHEN status IN ('processing', 'pending') AND size % 2 = 1 AND kind = 'pdf' THEN 3 ELSE attempts END AS attempts,
    CASE WHEN status IN ('processing', 'pending') AND size % 2 = 0 THEN '{SIGNATURE}' ELSE model_sig END AS model_sig FROM assets""")
def save_results(spark: SparkSession, d: str) -> DataFrame:
    assets = t(spark, d, "assets")
    bad = F.col("size") % 2 == 1
    outcome = assets.where("status in ('processing', 'pending')").withColumns({"error": F.when(bad, "broken"), "lasting": F.col("kind") == "pdf"})
    return c.finished(assets, outcome, SIGNATURE).select("hash", "status", "attempts", "model_sig")


@query("SELECT hash, arg_min(kind, id) AS kind, arg_min(size, id) AS size FROM files WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM assets WHERE status <> 'pending') GROUP BY hash")
def new_assets(spark: SparkSession, d: str) -> DataFrame:
    return c.new_assets(t(spark, d, "files"), t(spark, d, "assets").where("status <> 'pending'"))


@query("SELECT * FROM jobs WHERE id = (SELECT max(id) FROM jobs)")
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return c.latest_job(t(spark, d, "jobs"))


@query("""WITH ch AS (SELECT query, hash, CASE WHEN relevant = 1 THEN NULL ELSE 1 END AS r FROM judgments WHERE hash IS NOT NULL)
    SELECT query, hash, 1 AS relevant FROM ch WHERE r IS NOT NULL UNION ALL SELECT query, hash, relevant FROM judgments WHERE hash IS NULL AND relevant IS NOT NULL""")
def judge(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "judgments")
    changes = j.where("hash is not null").select("query", "hash", F.when(F.col("relevant") != 1, 1).alias("relevant"), F.lit(2).alias("at"))
    older = changes.withColumns({"relevant": F.lit(0), "at": F.lit(1)})
    return c.judged(j, changes.unionByName(older))


@query("SELECT key, CASE WHEN key = 'vectors_version' THEN '2' ELSE value END AS value FROM meta UNION ALL SELECT 'evalnote:x', 'seen'")
def put_values(spark: SparkSession, d: str) -> DataFrame:
    return c.put_values(t(spark, d, "meta"), {"vectors_version": "2", "evalnote:x": "seen"}, spark)


@query("SELECT id, CASE WHEN hash IN (SELECT hash FROM assets WHERE kind = 'pdf') THEN -id ELSE id END AS new_id FROM vectors")
def replace_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = t(spark, d, "vectors")
    fresh = v.join(t(spark, d, "assets").where("kind = 'pdf'").select("hash"), "hash", "left_semi").select("hash", "id", (-F.col("id")).alias("new_id"))
    return c.replaced_vectors(v.select("hash", "id", F.col("id").alias("new_id")), fresh).select("id", "new_id")


@query("""SELECT path, CASE WHEN l.path IS NOT NULL THEN l.size ELSE f.size END AS size, coalesce(f.first_seen, l.listed_at) AS first_seen FROM files f FULL OUTER JOIN
    (SELECT path, arg_max(size, (listed_at, mtime, size)) AS size, max(listed_at) AS listed_at FROM listing WHERE path IS NOT NULL GROUP BY path) l USING (path)""")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    new = c.newest_sightings(t(spark, d, "listing")).select("path", "size", F.col("listed_at").alias("first_seen"))
    return c.upserted(t(spark, d, "files").select("path", "size", "first_seen"), new, ["path"], keep=["first_seen"])


_WORK = f"""WITH l AS (SELECT path, arg_max(size, (listed_at, mtime, size)) AS size, arg_max(mtime, (listed_at, mtime, size)) AS mtime FROM listing WHERE path IS NOT NULL GROUP BY path)
    SELECT DISTINCT {{columns}} FROM l LEFT JOIN files f ON l.path = f.path LEFT JOIN assets a ON f.hash = a.hash, (SELECT value AS sig FROM meta WHERE key = 'model_sig')
    WHERE f.id IS NULL OR l.size IS DISTINCT FROM f.size OR abs(l.mtime - f.mtime) >= 0.001 OR (f.file_status = 'ok' AND f.hash IS NULL) OR {_OPEN.replace(f"'{SIGNATURE}'", "sig").replace("status IN", "a.status IN").replace("(status =", "(a.status =")}"""


def _work(spark: SparkSession, d: str) -> DataFrame:
    signature = t(spark, d, "meta").where(F.col("key") == "model_sig").first()["value"]
    return work_since(t(spark, d, "files"), t(spark, d, "assets"), t(spark, d, "listing"), signature)


@query(_WORK.format(columns="l.path"))
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The paths the next run must handle."""
    return _work(spark, d).select("path")


@query(_WORK.format(columns="l.path, l.size, l.mtime"))
def p7_work(spark: SparkSession, d: str) -> DataFrame:
    """The same with what was seen last."""
    return _work(spark, d)


# evaluation ------------------------------------------------------------------------------------------------------------------------

_RESULTS = """s AS (SELECT e.query, v.hash, max(list_dot_product(v.vec::DOUBLE[], e.text_vec::DOUBLE[])) AS sim FROM vectors v JOIN judgments j ON j.hash = v.hash JOIN eval_queries e ON e.query = j.query
        WHERE v.space = 'text' AND len(v.vec) = 64 AND NOT isnan(list_sum(v.vec)) AND v.hash IN (SELECT hash FROM assets WHERE status = 'done') GROUP BY 1, 2),
    results AS (SELECT query, hash, row_number() OVER (PARTITION BY query ORDER BY round(sim, 6) DESC, hash) AS rank FROM s),
    per AS (SELECT query, count(*) FILTER (rank <= 5) AS n, count(*) FILTER (rank <= 5 AND relevant IS NOT NULL) AS known, count(*) FILTER (rank <= 5 AND relevant = 1) AS good, min(rank) FILTER (relevant = 1) AS first, count(*) FILTER (relevant = 1) AS found
        FROM results LEFT JOIN judgments USING (query, hash) WHERE rank <= 10 GROUP BY query),
    wanted AS (SELECT query, count(DISTINCT hash) AS wanted FROM judgments WHERE relevant = 1 GROUP BY query),
    metrics AS (SELECT query, n > 0 AND n = known AS judged, CASE WHEN n > 0 AND n = known THEN round(good / n, 2) END AS p_at_k, CASE WHEN n > 0 AND n = known THEN round(coalesce(1 / first, 0), 2) END AS mrr,
        CASE WHEN n > 0 AND n = known THEN (good > 0)::INTEGER END AS hit, CASE WHEN n > 0 AND n = known THEN round(found / wanted, 2) END AS recall_at_10 FROM per LEFT JOIN wanted USING (query))"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Judged assets ranked by their best text cosine, so that every result has a judgment."""
    judgments, asked = t(spark, d, "judgments"), t(spark, d, "eval_queries").select("query", "text_vec")
    v = finished_vectors(t(spark, d, "vectors"), t(spark, d, "assets"), "text").where("size(vec) = 64").select("hash", "vec")
    pairs = v.join(judgments.select("query", "hash").distinct(), "hash").join(asked, "query").withColumn("sim", s.dot(F.col("vec"), F.col("text_vec")))
    best = pairs.where(~F.isnan("sim")).groupBy("query", "hash").agg(F.max("sim").alias("sim"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.round("sim", 6).desc(), "hash")))
    return e.metrics(ranked.select("query", "hash", "rank"), judgments)


@query(f"WITH {_RESULTS} SELECT query, judged, p_at_k, mrr, hit, recall_at_10 FROM metrics")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d)


@query(f"""WITH {_RESULTS} SELECT count(*) AS queries, count(*) FILTER (judged) AS fully_judged, round(avg(p_at_k), 3) AS mean_p_at_k, round(avg(mrr), 3) AS mean_mrr, round(avg(hit), 3) AS hit_rate_at_k, round(avg(recall_at_10), 3) AS mean_recall_at_10 FROM metrics""")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return e.summary(_metrics(spark, d))


# vectors of assets, frames -----------------------------------------------------------------------------------------------------------

_GOOD = "v AS (SELECT id, hash, vec::DOUBLE[] AS vec FROM vectors WHERE space = 'clip' AND len(vec) = 96 AND NOT isnan(list_sum(vec)))"
_MEANS = f"""{_GOOD}, parts AS (SELECT hash, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v), m AS (SELECT hash, i, avg(x) AS x FROM parts GROUP BY 1, 2),
    means AS (SELECT hash, list(x ORDER BY i) AS mean, sqrt(sum(x * x)) AS norm FROM m GROUP BY hash)"""


@query(f"WITH {_MEANS} SELECT hash, round(mean[1] / CASE WHEN norm = 0 THEN 1 ELSE norm END, 4) AS first, round(mean[96] / CASE WHEN norm = 0 THEN 1 ELSE norm END, 4) AS last FROM means")
def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    m = features.mean_vectors(t(spark, d, "vectors"), "clip", 96)
    return m.select("hash", F.round(F.col("vec")[0], 4).alias("first"), F.round(F.col("vec")[95], 4).alias("last"))


@query(f"""WITH {_MEANS}, sims AS (SELECT hash, 'tag' || e.id AS tag, list_dot_product(mean, e.clip_vec::DOUBLE[]) / CASE WHEN norm = 0 THEN 1 ELSE norm END AS sim FROM means, eval_queries e),
    top AS (SELECT hash, tag, row_number() OVER (PARTITION BY hash ORDER BY sim DESC, tag) AS k FROM sims WHERE sim >= 0.2)
    SELECT m.hash, coalesce(string_agg(tag, ' ' ORDER BY k), '') AS tags FROM means m LEFT JOIN (SELECT * FROM top WHERE k <= 5) t ON m.hash = t.hash GROUP BY m.hash""")
def zero_shot_tags(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = [(f"tag{x['id']}", x["clip_vec"]) for x in t(spark, d, "eval_queries").select("id", "clip_vec").collect()]
    found = features.zero_shot_tags(features.mean_vectors(t(spark, d, "vectors"), "clip", 96), vocabulary)
    return found.select("hash", F.array_join("tags", " ").alias("tags"))


@query("""WITH RECURSIVE ev AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    kept AS (SELECT user_id, k, t, t AS last, true AS keep FROM ev WHERE k = 1
        UNION ALL SELECT e.user_id, e.k, e.t, CASE WHEN e.t - p.last >= 172800 THEN e.t ELSE p.last END, e.t - p.last >= 172800 FROM kept p JOIN ev e ON e.user_id = p.user_id AND e.k = p.k + 1)
    SELECT user_id, t FROM kept WHERE keep""")
def greedy_keyframes(spark: SparkSession, d: str) -> DataFrame:
    times = t(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return frames.kept_rows(times, "user_id", "t", 172_800.0)


@query("""WITH g AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id)
    SELECT user_id, unnest(list_distinct(CASE WHEN len(ids) <= 4 THEN ids ELSE list_transform(range(0, 4), lambda i: ids[round_even(i * (len(ids) - 1) / 3.0::DOUBLE, 0)::BIGINT + 1]) END)) AS event_id FROM g""")
def even_downsample(spark: SparkSession, d: str) -> DataFrame:
    return frames.evenly_rows(t(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 4)


@query("""SELECT hash, unnest(list_transform(range(0, least(floor(meta.duration / greatest(1, meta.duration / 60))::BIGINT, 59) + 1), lambda i: round(i * greatest(1, meta.duration / 60), 4))) AS t FROM assets WHERE kind = 'video' AND meta.duration > 0""")
def candidate_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "assets").where("kind = 'video' and meta.duration > 0").select("hash", F.explode(frames.candidate_times(F.col("meta.duration"))).alias("t"))
    return rows.select("hash", F.round("t", 4).alias("t"))


_OVERLAP = "list_sum(list_transform(list_zip(f.h, s.lh), lambda z: sqrt(z[1] * z[2])))"
_SCALE = "sqrt(list_sum(f.h) * list_sum(s.lh))"


@query(f"""WITH RECURSIVE f AS (SELECT hash, ref AS t, list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE) AS h, row_number() OVER (PARTITION BY hash ORDER BY ref, list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE)) AS k
        FROM vectors WHERE source = 'frame' AND ref IS NOT NULL AND len(vec) = 96 AND len(list_filter(vec, lambda x: isnan(x))) = 0),
    s AS (SELECT hash, k, t, t AS lt, h AS lh, true AS keep FROM f WHERE k = 1
        UNION ALL SELECT hash, k, t, CASE WHEN keep THEN t ELSE lt END, CASE WHEN keep THEN h ELSE lh END, keep FROM (
            SELECT f.hash, f.k, f.t, f.h, s.lt, s.lh, f.t - s.lt >= 4 OR sqrt(greatest(0::DOUBLE, 1 - CASE WHEN {_SCALE} > 0 THEN {_OVERLAP} / {_SCALE} ELSE 0 END)) > 0.35 AS keep
            FROM s JOIN f ON f.hash = s.hash AND f.k = s.k + 1)),
    g AS (SELECT hash, list(t ORDER BY k) AS ts FROM s WHERE keep GROUP BY hash)
    SELECT hash, unnest(CASE WHEN len(ts) <= 16 THEN ts ELSE list_transform(list_distinct(list_transform(range(0, 16), lambda i: round_even(i * (len(ts) - 1) / 15.0::DOUBLE, 0)::BIGINT)), lambda p: ts[p + 1]) END) AS t FROM g""")
def scene_keyframes(spark: SparkSession, d: str) -> DataFrame:
    """Frame vectors as stand-ins for histograms: their squares sum to one, as a histogram's do."""
    v = t(spark, d, "vectors").where("source = 'frame' and ref is not null and size(vec) = 96").where(~F.exists("vec", lambda x: F.isnan(x)))
    rows = v.select("hash", F.col("ref").alias("t"), F.lit(100.0).alias("brightness"), F.transform("vec", lambda x: x.cast("double") * x.cast("double")).alias("hist"))
    return frames.keyframes(rows).select("hash", F.explode("times").alias("t"))


@query("""SELECT hash, len(list_distinct(list_filter(tags, lambda x: x IS NOT NULL))) AS n FROM assets WHERE tags IS NOT NULL""")
def distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "assets").where("tags is not null").select("hash", F.size(F.array_distinct(F.array_compact("tags"))).cast("long").alias("n"))
