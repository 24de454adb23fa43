"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, conversations, decontam, embeddings, features, fm_dedup, jaccard, language, mixing, packing, quality, run_length_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_dedup.digest(run_length_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_conflicts(_table(spark, sf_dir, "conversations"))))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out(_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.digest(fm_dedup.remove_later_repeats(_table(spark, sf_dir, "documents")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.similar_texts(_table(spark, sf_dir, "documents"), jaccard.Similarity(words=3, at_least=90))
    return out.select("doc_id", "n_shingles", "component_id")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.point_in_time(*(_table(spark, sf_dir, name) for name in ("sales", "clicks", "sale_lines")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_array_dedup, op2_toxicity, op3_quality, op4_chat_formatting, op5_language_id, op6_embedding_near_dedup, op7_benchmark_decontamination, op8_substring_dedup, op9_source_mixing, op10_ngram_jaccard_join, op11_packing, op12_point_in_time, op13_conversation_repair)
    return {f.__name__: f for f in found}


OP1 = r"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS s FROM docs)
), found AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1
), runs AS (
  SELECT doc_id, s, sum(first) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
    SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS first FROM found)
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM runs GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, b AS a FROM spans UNION ALL SELECT doc_id, 0 FROM docs
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * c.a + 1, 2 * (coalesce(e, len(h) // 2) - c.a)), '' ORDER BY c.a) AS h
  FROM (SELECT c.doc_id, c.a, min(n.a) AS e FROM cuts c LEFT JOIN spans n ON n.doc_id = c.doc_id AND n.a >= c.a GROUP BY ALL) c JOIN docs USING (doc_id) GROUP BY doc_id
), gone AS (
  SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, (len(docs.h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

def _nested(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new}')"
    return text


_BROKEN = [(x, f"{x[0]}\\{x[1:]}") for x in chat.CONTROL]
_MENDED = [(new, old) for old, new in _BROKEN]
_HOLDS = " OR ".join(f"contains(role || chr(10) || text, '{x}')" for x in chat.CONTROL)
_SURVIVES = " AND ".join(f"{_nested(_nested(c, _BROKEN), _MENDED)} = {c}" for c in ("role", "text"))
OP4 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), levels AS (
  SELECT *, CASE WHEN NOT ({_HOLDS}) THEN 0 WHEN {_SURVIVES} THEN 1 ELSE 2 END AS level FROM turns
), rendered AS (
  SELECT *, CASE level WHEN 0 THEN role || text WHEN 1 THEN {_nested("role", _BROKEN)} || {_nested("text", _BROKEN)}
    ELSE {_nested("role", [("\\", "\\\\"), *_BROKEN])} || {_nested("text", [("\\", "\\\\"), *_BROKEN])} END AS e FROM levels
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(21 + length(e))::BIGINT AS formatted_chars
FROM rendered GROUP BY conv_id
"""

OP6 = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), good AS (
  SELECT * FROM vectors WHERE label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, m AS component_id, vec_id = m AS kept FROM least LEFT JOIN degree USING (vec_id)
"""

OP8 = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM windows) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP9 = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(1.0::DOUBLE - 0.75::DOUBLE * length(regexp_replace(text, '[\p{L}\x09-\x0D\x20.,]+', '', 'g')) / nullif(length(text), 0), 0.25::DOUBLE) AS quality,
    (('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 16.0::DOUBLE ** 12 AS u
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(place - 1) % 3 + 1] AS weight, (3 * source_size)::DOUBLE AS cap FROM sizes
), levels AS (
  SELECT a.place, max(a.cap / a.weight) AS own,
    (sum(b.source_size)::DOUBLE - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0)) / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level
  FROM weighed a, weighed b GROUP BY a.place
), targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, own) FROM levels WHERE level <= own)) AS target FROM weighed
), plan AS (
  SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM targets)
), ahead AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / quality, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM docs
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM ahead JOIN plan ON ahead.source IS NOT DISTINCT FROM plan.source
"""

OP10 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


#: The table of the checksum, from its polynomial, and the checksum of an ASCII text by it.
STEPS = "SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)"


def _crc(text: str) -> str:
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP12 = f"""
WITH steps AS (
  {STEPS}
), asked AS (
  SELECT row_number() OVER () AS r, sale_id, client_id, epoch_us(sold_at) AS e, epoch_us(arrived_at) + 14400000000 AS known, coalesce(floor(100 * total + 0.5)::BIGINT, 0) AS cents,
    epoch_us(sold_at) + {_crc("sale_id::VARCHAR")} % 259200 * 1000000 AS t
  FROM sales, steps WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), probes AS (SELECT r, sale_id, client_id, t, d FROM asked, (SELECT unnest([2, 14])::INT AS d)),
once AS (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks),
seen AS (
  SELECT r, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(coalesce(floor(100 * value + 0.5)::BIGINT, 0)) AS click_cents, arg_max(click_id, (ts, click_id)) AS last_click_id
  FROM probes p JOIN once c ON c.client_id = p.client_id AND epoch_us(c.ts) > t - d * 86400000000 AND epoch_us(c.ts) <= t AND epoch_us(c.arrived_at) + 14400000000 <= t GROUP BY r, d
), before AS (
  SELECT p.r, d, p.t, s.r AS q, s.sale_id, s.cents FROM probes p JOIN asked s ON s.client_id = p.client_id AND s.e > p.t - d * 86400000000 AND s.e <= p.t AND s.known <= p.t
), bought AS (SELECT r, d, count(*) AS n_sales, sum(cents) AS sale_cents FROM before GROUP BY r, d),
sent AS (
  SELECT r, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(coalesce(floor(100 * amount + 0.5)::BIGINT, 0)) AS line_cents
  FROM before b JOIN sale_lines l ON l.sale_id = b.sale_id AND epoch_us(l.shipped_at) <= b.t GROUP BY r, d
), labels AS (SELECT DISTINCT p.r FROM asked p JOIN asked s ON s.client_id = p.client_id AND s.e > p.t AND s.e <= p.t + 604800000000)
SELECT p.sale_id, p.d, p.t AS t_us, l.r IS NOT NULL AS label, coalesce(n_clicks, 0)::BIGINT AS n_clicks, coalesce(n_purchases, 0)::BIGINT AS n_purchases, coalesce(click_cents, 0)::BIGINT AS click_cents, last_click_id,
  coalesce(n_sales, 0)::BIGINT AS n_sales, coalesce(sale_cents, 0)::BIGINT AS sale_cents, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(line_cents, 0)::BIGINT AS line_cents
FROM probes p LEFT JOIN seen USING (r, d) LEFT JOIN bought USING (r, d) LEFT JOIN sent USING (r, d) LEFT JOIN labels l ON l.r = p.r
"""

OP13 = rf"""
WITH RECURSIVE steps AS (
  {STEPS}
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
  FROM conversations, steps
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM hashed, (SELECT unnest(range(2)) AS copy) WHERE h <> 0 AND (copy = 0 OR h = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid FROM damaged
), judged AS (
  SELECT *, CASE WHEN solid = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS k FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || k NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), costs AS (
  SELECT conv_id, n AS i, 6::BIGINT AS n0, 6::BIGINT AS ns, 3::BIGINT AS nu, 0::BIGINT AS na, 0::BIGINT AS f0 FROM counts
  UNION ALL
  SELECT conv_id, i, least(b0, 3 + least(bu, 3 + ba)), least(bs, 3 + least(bu, 3 + ba)), least(bu, 3 + ba), least(ba, 3 + bu), least(b0, 3 + least(bu, 3 + ba)) FROM (
    SELECT j.conv_id, j.i,
      least(4 + p0, CASE WHEN fault IN ('', 't') THEN (CASE WHEN fault = 't' THEN 3 ELSE 0 END) + least(3 + c.nu, CASE k WHEN 's' THEN c.ns WHEN 'u' THEN c.nu ELSE 999999999 END) ELSE 999999999 END) AS b0,
      least(4 + c.ns, CASE WHEN fault IN ('', 't') THEN (CASE WHEN fault = 't' THEN 3 ELSE 0 END) + least(3 + c.nu, CASE k WHEN 'u' THEN c.nu ELSE 999999999 END) ELSE 999999999 END) AS bs,
      least(4 + c.nu, CASE WHEN fault IN ('', 't') THEN (CASE WHEN fault = 't' THEN 3 ELSE 0 END) + least(3 + c.na, CASE k WHEN 'a' THEN c.na ELSE 999999999 END) ELSE 999999999 END) AS bu,
      least(4 + c.na, CASE WHEN fault IN ('', 't') THEN (CASE WHEN fault = 't' THEN 3 ELSE 0 END) + least(3 + c.nu, CASE k WHEN 'u' THEN c.nu ELSE 999999999 END) ELSE 999999999 END) AS ba
    FROM (SELECT *, f0 AS p0 FROM costs) c JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id AND j.i = c.i - 1)
)
, walk AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS s, '' AS audit, '' AS made, 0::BIGINT AS step FROM counts
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND k = 's' THEN 's' WHEN s = 'u' THEN 'a' ELSE 'u' END, audit || e,
    made || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE WHEN s = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END END, step + 1
  FROM (
    SELECT w.*, j.k, j.role, j.text, CASE
      WHEN j.k IS NOT NULL AND now = 4 + CASE s WHEN '0' THEN x.f0 WHEN 's' THEN x.ns WHEN 'u' THEN x.nu ELSE x.na END THEN 'D'
      WHEN now = 3 + CASE s WHEN 'u' THEN c.na ELSE c.nu END THEN 'I'
      WHEN fault IN ('', 't') AND now = (CASE WHEN fault = 't' THEN 3 ELSE 0 END) + CASE WHEN s = '0' AND k = 's' THEN x.ns WHEN s <> 'u' AND k = 'u' THEN x.nu WHEN s = 'u' AND k = 'a' THEN x.na ELSE 999999999 END THEN 'K'
      ELSE 'R' END AS e
    FROM walk w JOIN (SELECT * FROM costs) c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i, LATERAL (SELECT CASE w.s WHEN '0' THEN c.f0 WHEN 's' THEN c.ns WHEN 'u' THEN c.nu ELSE c.na END AS now)
      LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i LEFT JOIN (SELECT * FROM costs) x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1
    WHERE j.k IS NOT NULL OR now > 0)
), ends AS (
  SELECT conv_id, arg_max(audit, step) AS audit, arg_max(made, step) AS made FROM walk GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(f0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN (SELECT * FROM costs WHERE i = 0) z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": OP1,
        "op4_chat_formatting": OP4,
        "op6_embedding_near_dedup": OP6,
        "op8_substring_dedup": OP8,
        "op9_source_mixing": OP9,
        "op10_ngram_jaccard_join": OP10,
        "op12_point_in_time": OP12,
        "op13_conversation_repair": OP13,
    }
