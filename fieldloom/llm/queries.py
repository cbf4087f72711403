"""The registered queries of this folder, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import table
from fieldloom.llm.decontamination import contaminated
from fieldloom.llm.embeddings import near_duplicate_vectors
from fieldloom.llm.filter_audit import audit_documents
from fieldloom.llm.language import learn, predict
from fieldloom.llm.lattice_lm import lattice_scores
from fieldloom.llm.licenses import license_scan
from fieldloom.llm.packing import pack_documents
from fieldloom.llm.secret_scan import BASE_RULES, find_secrets
from fieldloom.llm.sharding import hilbert_indices, shard_documents
from fieldloom.llm.simhash import near_duplicates
from fieldloom.llm.substrings import repeated_passages
from fieldloom.llm.toxicity import learn_toxicity, score_toxicity
from fieldloom.llm.vector_codes import compress_vectors


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; all spans of the base kinds, and of the other rules."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 whose counts are at most one apart, in runs of a Hilbert curve."""
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at a cosine of 0.95, and the smallest vec_id that links reach."""
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents that lie in passages which other documents repeat."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words that lie within windows of 10 words of the benchmark items."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = learn(docs.where(~held_out), "text", "lang", F.col("doc_id"))
    return predict(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, own or inherited; a document is a file in its source's directory of a thousand ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    found = license_scan(docs, path)
    return found.select("doc_id", "path", F.array_join("licenses", ",").alias("licenses"), "n_findings", "origin", "from_dir")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every document, and the smallest doc_id that links of at most 4 bits reach."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a subword lattice, under one with word arcs, and under an add-one word unigram."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return lattice_scores(table(spark, sf_dir, "documents"), held_out, public_tokenizers.path("piece_bpe_32k.model"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as four codes of a byte, with codebooks of 256 entries fitted to all vectors in four rounds."""
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", F.col("group_error").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove by source, in each of their 120 orders and at each step."""
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = learn_toxicity(docs.where(~held_out), table(spark, sf_dir, "labels"))
    found = score_toxicity(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")])
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_simhash": op9_simhash,
    "op10_lattice_lm": op10_lattice_lm,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
}


def _secrets_sql() -> str:
    """Each kind's matches with the text before each; their places are running sums of lengths."""
    value = "[A-Za-z0-9+/_.=-]"
    assign = f"""(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?"""
    kinds = {
        "assign": (f"{assign}{value}+", f"{assign}{value}{{6,}}"),
        "access": ("AKIA[A-Z0-9]+", ".{20,}"),
        "hex": ("[0-9a-f]+", ".{24,}"),
        "forge": ("gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"),
        "webtoken": ("eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", ".*"),
        "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", ".*"),
    }
    parts = [
        f"""SELECT row, {k} AS rank, '{kind}' AS kind, unnest(regexp_extract_all(text, '(?s)(.*?)({p})', 1)) AS before, unnest(regexp_extract_all(text, '(?s)(.*?)({p})', 2)) AS found,
        generate_subscripts(regexp_extract_all(text, '(?s)(.*?)({p})', 2), 1) AS nth, '{keep}' AS keep FROM d"""
        for k, (kind, (p, keep)) in enumerate(kinds.items())
    ]
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    s AS (SELECT *, sum(length(before) + length(found)) OVER (PARTITION BY row, rank ORDER BY nth) AS stop FROM m),
    k AS (SELECT row, rank, kind, stop - length(found) AS start, kind || ':' || cast(stop - length(found) AS bigint) || ':' || cast(stop AS bigint) AS told
          FROM s WHERE regexp_full_match(found, keep, 's')),
    g AS (SELECT row, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS c, count(*) FILTER (rank = 2) AS h,
          string_agg(told, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(told, ',' ORDER BY start, rank) AS spans FROM k GROUP BY row)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (row)"""


def _sharding_sql() -> str:
    """CRC-32 from its table of 256 remainders, computed here by the defining shifts."""
    cells = ", ".join(map(str, hilbert_indices(3, 4)))
    step = "CASE WHEN {c} % 2 = 1 THEN xor({c} >> 1, 3988292384::ubigint) ELSE {c} >> 1 END"
    table = "i::ubigint AS c0 FROM range(256) r(i)"
    for k in range(8):
        table = f"i, {step.format(c=f'c{k}')} AS c{k + 1} FROM (SELECT i, {table})" if k else f"i, {step.format(c='c0')} AS c1 FROM (SELECT i, {table})"
    byte = "('0x' || substr({hx}, 2 * i - 1, 2))::ubigint"
    crc = lambda hx: f"xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, 1 + length({hx}) // 2), lambda i: {byte.format(hx=hx)})), lambda c, b: xor(c >> 8, crc[(1 + (xor(c, b) & 255))::bigint])), 4294967295::ubigint)::bigint"
    return f"""
    WITH t AS (SELECT list(c8 ORDER BY i) AS crc FROM (SELECT {table})),
    b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS data, hex(encode(source)) AS s, hex(encode(lang)) AS l FROM documents),
    d AS (SELECT doc_id, length(data) // 2 + 1 AS size, {crc("data")} AS text_crc32,
          CASE WHEN s IS NULL THEN 0 ELSE {crc("s")} & 15 END AS x, CASE WHEN l IS NULL THEN 0 ELSE {crc("l")} & 15 END AS y FROM b, t),
    c AS (SELECT *, least(length(ltrim(to_base(size // 64, 2), '0')), 16) AS bin FROM d),
    h AS (SELECT doc_id, size, text_crc32, [{cells}][1 + x * 256 + y * 16 + greatest(bin - 1, 0)]::bigint AS curve, (((coalesce(doc_id, 0) & 2147483647) * 2654435761) & 4294967295) >> 22 AS part, x * 16 + y AS labels FROM c),
    p AS (SELECT *, row_number() OVER (ORDER BY curve, part, doc_id NULLS FIRST, size, text_crc32, labels) - 1 AS place, count(*) OVER () AS total FROM h)
    SELECT doc_id, size::bigint AS size, text_crc32, 'rows' AS law, (place * 8 // total)::int AS shard, (place - ((place * 8 // total) * total + 7) // 8)::bigint AS slot, NULL::int AS grown_shard, curve FROM p"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_DECONTAMINATION_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    n AS (SELECT DISTINCT item, array_to_string(w[k:k + 9], ' ') AS win, least(len(w), 10) AS size FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
    a AS (SELECT row, pos, size, item FROM (SELECT row, w, unnest(range(1, len(w) - size + 2)) AS pos, size FROM d, (SELECT DISTINCT size FROM n) WHERE len(w) >= size) JOIN n USING (size) WHERE array_to_string(w[pos:pos + size - 1], ' ') = win),
    h AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(pos, pos + size)) AS k FROM a) GROUP BY row),
    g AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM a GROUP BY row)
    SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (row) LEFT JOIN g USING (row)"""

_EMBEDDING_SQL = """
    WITH RECURSIVE e AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
          AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x::double * x::double)) > 0),
    l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id <= coalesce(c.b, vec_id) AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""



def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds one after the other; a quotient is rounded down by taking off its remainder first."""
    assigned = "SELECT q.row, q.part, min({{'d': list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2])::hugeint * (z[1] - z[2]))), 'e': b.e}}) AS m FROM q JOIN b{n} b USING (part) GROUP BY q.row, q.part"
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({assigned.format(n=n)})")
        steps.append(f"""s{n} AS (SELECT part, e, i, sum(v) AS s, count(*) AS n FROM (SELECT q.part, m.e AS e, unnest(q.x) AS v, generate_subscripts(q.x, 1) AS i FROM q JOIN a{n} USING (row, part)) GROUP BY part, e, i)""")
        steps.append(f"t{n} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::bigint[] AS x FROM s{n} GROUP BY part, e)")
        steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(t.x, b.x) AS x FROM b{n} b LEFT JOIN t{n} t USING (part, e))")
    return f"""
    WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
    q AS MATERIALIZED (SELECT row, vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, range({parts}) r(part)),
    b0 AS MATERIALIZED (SELECT part, e, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM q) WHERE e < {entries}),
    {", ".join(steps)},
    f AS (SELECT row, string_agg(printf('%02x', (m.e)::int), '' ORDER BY part) AS code, sum(m.d)::bigint AS error FROM ({assigned.format(n=rounds)}) GROUP BY row),
    g AS (SELECT label, sum(error)::bigint AS label_error FROM k JOIN f USING (row) GROUP BY label),
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS digest FROM b{rounds})
    SELECT vec_id, code, error, label_error, digest AS codebooks_sha256 FROM k JOIN f USING (row) JOIN g ON k.label IS NOT DISTINCT FROM g.label, h"""


_AUDIT_SQL = """
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    e AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
    l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    t AS (SELECT part, (len(w) < 50)::int + 2 * (100 * list_unique(w) < 65 * len(w))::int + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::int
             + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * (doc_id IS DISTINCT FROM first)::int AS bits, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
          FROM d JOIN e USING (text) LEFT JOIN l USING (doc_id)),
    k AS (SELECT part, bits, good, toxic, count(*) AS n FROM t GROUP BY ALL),
    o(name, used, step) AS (SELECT '', 0, 0 UNION ALL SELECT name || substr('ABCDE', b + 1, 1), used | (1 << b), step + 1 FROM o, range(5) r(b) WHERE used & (1 << b) = 0),
    s AS (SELECT o.name AS filter_order, s.step, s.used & (1 << (instr('ABCDE', substr(o.name, s.step, 1)) - 1)) AS bit, s.used AS done
          FROM o JOIN o s ON s.step > 0 AND starts_with(o.name, s.name) WHERE o.step = 5),
    c AS (SELECT k.part, s.filter_order, s.step, s.bit,
             coalesce(sum(n) FILTER (bits & done = 0), 0) AS kept, coalesce(sum(n) FILTER (bits & done = bit), 0) AS removed, coalesce(sum(n) FILTER (bits & bit > 0 AND bits & (done - bit) > 0), 0) AS redundant,
             coalesce(sum(n) FILTER (bits = bit), 0) AS unique_fails, coalesce(sum(n) FILTER (bits & done = bit AND good), 0) AS good_lost, coalesce(sum(n) FILTER (bits & done = bit AND toxic), 0) AS toxic_lost
          FROM k, s GROUP BY ALL)
    SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
           good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley FROM c"""

ORACLE_SQL = {
    "op1_secret_scan": _secrets_sql(),
    "op3_sharding": _sharding_sql(),
    "op4_embedding_dedup": _EMBEDDING_SQL,
    "op6_decontamination": _DECONTAMINATION_SQL,
    "op11_vector_codes": _codes_sql(),
    "op12_filter_audit": _AUDIT_SQL,
}
