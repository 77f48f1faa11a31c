"""One query per operator, with production parameters, over its whole tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from buildlens.llm.bpe_automaton import encode_digests
from buildlens.llm.collocations import collocations
from buildlens.llm.decontaminate import find_leaks
from buildlens.llm.divergence import source_divergence
from buildlens.llm.html_main_text import extract_main_text
from buildlens.llm.jaccard_join import jaccard_components
from buildlens.llm.langid import identify_languages
from buildlens.llm.mixing import mix_sources
from buildlens.llm.pii import pseudonymise
from buildlens.llm.quality import quality_scores
from buildlens.llm.secret_scan import scan_secrets
from buildlens.llm.shared import fresh_path
from buildlens.llm.token_counts import token_counts
from buildlens.llm.vector_graph import near_vectors

#: Key of the pseudonyms in the registered query; a deployment sets its own.
PII_KEY = "buildlens-demonstration-key"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own for each call, so that every call encodes all distinct texts
    return token_counts(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), fresh_path(spark, "token-cache")
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_main_text": op1_html_main_text,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_pii": op5_pii,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_decontaminate": op8_decontaminate,
    "op9_bpe": op9_bpe,
    "op10_vector_graph": op10_vector_graph,
    "op11_source_divergence": op11_source_divergence,
    "op12_mixing": op12_mixing,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": r"""WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = s.doc_id) AS component_id FROM sets s""",
    "op11_source_divergence": r"""WITH docs AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
terms AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
kept AS (SELECT w.* FROM words w JOIN terms USING (lang, term)),
sizes AS (SELECT lang, count(*) AS v FROM terms GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, t.term, count(k.row) AS n FROM groups g JOIN terms t ON g.lang = t.lang
  LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term GROUP BY ALL),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM cells JOIN sizes USING (lang)),
langs AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM cells JOIN sizes USING (lang) GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
more AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares JOIN langs USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM more)) WHERE part = 'pair' OR rank <= 50""",
    "op12_mixing": r"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 12) AS hash FROM documents),
sources AS (SELECT source, sum(size)::HUGEINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source),
ranked AS (SELECT *, sum(2 * source_size) OVER w AS caps, sum(weight) OVER w AS weights, sum(source_size) OVER () AS words, sum(weight) OVER () AS every
  FROM (SELECT source, source_size, weight FROM sources) WINDOW w AS (ORDER BY 12 * source_size // weight)),
level AS (SELECT coalesce(max(caps) FILTER (fits), 0) AS caps, coalesce(max(weights) FILTER (fits), 0) AS weights FROM
  (SELECT *, 12 * caps + 12 // weight * 2 * source_size * (every - weights) <= 18 * words AS fits FROM ranked)),
targets AS (SELECT source, source_size, CASE WHEN r.caps <= l.caps THEN 4 * source_size ELSE ((3 * words - 2 * l.caps) * weight)::HUGEINT END AS up,
  CASE WHEN r.caps <= l.caps THEN 2 ELSE (2 * (every - l.weights))::HUGEINT END AS down FROM ranked r, level l),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN up // (down * source_size) ELSE 0 END AS rounds FROM targets),
placed AS (SELECT s.doc_id, s.size, r.source_size, r.up, r.down, r.rounds, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY hash, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, up::DOUBLE / down::DOUBLE AS target,
  (size * (rounds + CASE WHEN 2 * (up - rounds * source_size * down - before * down) > size * down THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed""",
    "op13_collocations": r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, unnest(flatten([[array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)] FOR k IN [1, 2, 3, 4]])) AS phrase FROM split WHERE len(w) > 0),
freq AS (SELECT lang, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
long AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, len(string_split(phrase, ' ')) AS k FROM freq WHERE contains(phrase, ' ')),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM long),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a // (h.f + t.f))::BIGINT AS score FROM cuts c
  JOIN freq h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN freq t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (SELECT lang, a, unnest(flatten([[array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, k - s + 2)] FOR s IN range(2, k)])) AS phrase FROM long WHERE k > 2),
longest AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
ranked AS (SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, w.l, w.r, s.n, w.score
  FROM weakest w JOIN sizes s ON s.lang = w.lang LEFT JOIN longest m ON m.lang = w.lang AND m.phrase = w.phrase WHERE m.most IS NULL OR 100 * m.most < 80 * w.a)
SELECT * FROM ranked WHERE rank <= 2000""",
}
