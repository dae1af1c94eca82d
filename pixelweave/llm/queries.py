"""One query for each operator of this package, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_blocks, licenses, maxscore, merkle, mixing, near_dup, pieces, simhash, token_blocks, toxicity, warc, whitening

#: Seed of the seeded order of the mix.
MIX_SEED = 17


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_blocks.write_token_files(_table(spark, sf_dir, "documents"), byte_bpe)
    return token_blocks.read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_bundles(_table(spark, sf_dir, "pages"))
    return warc.read_bundles(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _every_hundredth(identifier: Column) -> Column:
    return identifier % 100 == 0


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), _every_hundredth)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(_table(spark, sf_dir, "pages"))


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(_table(spark, sf_dir, "embeddings"), _every_hundredth)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"), piece_model())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(_table(spark, sf_dir, "documents"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return rows.select("doc_id", *[F.col(f"ls_{n}").alias(n) for n in names])


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents"), seed=MIX_SEED)
    return rows.select("doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), F.col("mx_taken").alias("taken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    rows = toxicity.scores(docs, model)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = rows.select("vec_id", F.col("wh_deviation").alias("deviation"), F.posexplode("wh_vector").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e)) for e in model.explained or [0.0]]), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, _lower_ascii(text)).otherwise(text)
    rows = merkle.manifest(_table(spark, sf_dir, "documents"), tampered)
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return rows.select("doc_id", *[F.col(f"mk_{n}").alias(n) for n in names])


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.classes(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_blocks, op2_near_duplicates, op3_warc, op4_nearest_neighbours, op5_main_text, op6_maxscore, op7_pieces, op8_license_scan, op9_mix, op10_toxicity, op11_whitening, op12_merkle, op13_simhash)}


#: The ten highest integer inner products by comparing every query with every row.
MAXSCORE_SQL = """
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.w, d.w) AS BIGINT) AS score FROM w q JOIN w d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

#: The base32 text of a SHA-1 from five hexadecimal digits (four characters) at a time.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {1 + 5 * k}, 5) AS INT) >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h AS fh, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM p JOIN f ON h = fh
"""

#: Water-filling by sorted caps, and the seeded order cut in two levels of cells.
MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
e AS (SELECT doc_id, source, size, CAST('0x' || substr(h, 1, 3) AS INT) AS cell, CAST('0x' || substr(h, 4, 3) AS INT) AS part FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM e GROUP BY source),
w AS (SELECT source, ss, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, CAST(ss * 2 AS DOUBLE) AS cap FROM s),
v AS (SELECT *, (CAST(sum(ss) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lev FROM v WHERE lev * w <= cap ORDER BY cap / w, lev LIMIT 1),
t AS (SELECT source, ss, least(cap, coalesce((SELECT lev FROM f) * w, cap)) AS target FROM v),
g AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole, target - CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END * ss AS lft FROM t),
c AS (SELECT source, cell, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY cell) AS run FROM e GROUP BY source, cell),
k AS (SELECT g.*, x.cell AS cut, greatest(0, g.lft - (x.run - x.n)) AS lft2 FROM g LEFT JOIN (SELECT c.source, c.cell, c.n, c.run, row_number() OVER (PARTITION BY c.source ORDER BY c.cell) AS rn FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE c.run > g.lft) x ON x.source IS NOT DISTINCT FROM g.source AND x.rn = 1),
p AS (SELECT e.source, e.part, sum(e.size) AS n, sum(sum(e.size)) OVER (PARTITION BY e.source ORDER BY e.part) AS run FROM e JOIN k ON e.source IS NOT DISTINCT FROM k.source AND e.cell = k.cut GROUP BY e.source, e.part),
z AS (SELECT k.*, y.part AS cut2, CASE WHEN y.n > 0 THEN greatest(0, k.lft2 - (y.run - y.n)) / y.n ELSE 0 END AS fraction FROM k LEFT JOIN (SELECT p.source, p.part, p.n, p.run, row_number() OVER (PARTITION BY p.source ORDER BY p.part) AS rn FROM p JOIN k ON p.source IS NOT DISTINCT FROM k.source WHERE p.run > k.lft2) y ON y.source IS NOT DISTINCT FROM k.source AND y.rn = 1)
SELECT doc_id, size, ss AS source_size, target, CAST(least(whole * size + floor(size * CASE WHEN cut IS NULL OR cell > cut THEN 0.0 WHEN cell < cut THEN 1.0 WHEN cut2 IS NULL OR part > cut2 THEN 0.0 WHEN part < cut2 THEN 1.0 ELSE fraction END + 0.5), size * 2) AS BIGINT) AS taken FROM e JOIN z ON e.source IS NOT DISTINCT FROM z.source
"""


#: Levels of 16 written out in the SQL: sources of up to 16^6 rows.
_LEVELS = 6


def _merkle_level(nodes: str, h: int) -> str:
    """Runs of level h, with the digests in order, and the nodes above them; a single node stays as it is."""
    runs = f"r{nodes}{h} AS (SELECT g, pos // 16 AS run, list(d ORDER BY pos) AS ds, max(n) AS n FROM {nodes}{h} GROUP BY g, pos // 16)"
    above = f"{nodes}{h + 1} AS (SELECT g, run AS pos, CAST(ceil(n / 16.0) AS BIGINT) AS n, CASE WHEN n = 1 THEN ds[1] ELSE sha256(list_aggregate(ds, 'string_agg', '')) END AS d FROM r{nodes}{h})"
    return f"{runs},\n{above}"


def _merkle_sql() -> str:
    """Levels of all sources (s0, s1, ...) and of the root (t0, t1, ...), then the siblings of every leaf gathered upwards."""
    field = lambda c, v=None: f"coalesce(CAST(strlen(CAST({v or c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v or c} AS VARCHAR), '-')"
    head = " || ".join(field(c) for c in merkle.FIELDS[:-1])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"
    parts = [
        f"tabs AS (SELECT {steps} AS tab)",
        f"l AS (SELECT doc_id, coalesce('s' || source, '') AS g, sha256({head} || {field('text')}) AS d, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field('text', lower)}) ELSE sha256({head} || {field('text')}) END AS t FROM documents, tabs)",
        "i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l)",
        "s0 AS (SELECT g, pos, n, d FROM i)",
        *[_merkle_level("s", h) for h in range(_LEVELS)],
        f"q AS (SELECT g AS source, d, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM s{_LEVELS})",
        "t0 AS (SELECT '' AS g, pos, n, d FROM q)",
        *[_merkle_level("t", h) for h in range(_LEVELS)],
        "u0 AS (SELECT i.doc_id, i.g, i.d AS leaf, q.d AS subroot, i.t AS x, '' AS proof, i.pos, i.n, q.pos AS tpos, q.n AS tn FROM i JOIN q ON i.g = q.source)",
    ]
    for k in range(2 * _LEVELS):
        nodes, h, key = ("s", k, "u.g") if k < _LEVELS else ("t", k - _LEVELS, "''")
        p, n = ("u.pos", "u.n") if nodes == "s" else ("u.tpos", "u.tn")
        rest = (f"{p} // 16 AS pos, CAST(ceil({n} / 16.0) AS BIGINT) AS n, u.tpos, u.tn" if nodes == "s" else f"u.pos, u.n, {p} // 16 AS tpos, CAST(ceil({n} / 16.0) AS BIGINT) AS tn")
        left = f"coalesce(list_aggregate(r.ds[1:CAST({p} % 16 AS INT)], 'string_agg', ''), '')"
        right = f"coalesce(list_aggregate(r.ds[CAST({p} % 16 AS INT) + 2:], 'string_agg', ''), '')"
        parts.append(f"u{k + 1} AS (SELECT u.doc_id, u.g, leaf, subroot, CASE WHEN {n} = 1 THEN x ELSE sha256({left} || x || {right}) END AS x, CASE WHEN {n} = 1 THEN proof ELSE proof || {left} || {right} END AS proof, {rest} FROM u{k} u JOIN r{nodes}{h} r ON r.g = {key} AND r.run = {p} // 16)")
    return f"WITH {', '.join(parts)}\nSELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = t.d AS verified FROM u{2 * _LEVELS}, t{_LEVELS} t"


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": WARC_SQL, "op6_maxscore": MAXSCORE_SQL, "op9_mix": MIX_SQL, "op12_merkle": _merkle_sql()}
