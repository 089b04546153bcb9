"""The registered queries of this subpackage, each beside its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.additive import quality
from millrace.llm.alignment import align_tokenizers
from millrace.llm.brown import perplexities
from millrace.llm.conversations import prefix_trie
from millrace.llm.decontaminate import find_leaks
from millrace.llm.mixing import mixed
from millrace.llm.outliers import quality_verdicts
from millrace.llm.overlap import linked_documents
from millrace.llm.passages import near_passages
from millrace.llm.setsketch import near_duplicates
from millrace.llm.suffixes import remove_repeats
from millrace.llm.toxicity import toxicity
from millrace.llm.warc import round_trip
from millrace.session import apply_settings

#: Where the public tokenizer files lie on every machine.
TOKENIZERS = "/opt/tokenizers"

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Registers a query under its function name."""

    def register(function: QueryFunction) -> QueryFunction:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(apply_settings(spark), sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_quality_outliers(spark, sf_dir):
    """Base rules and robust distances of every document."""
    return quality_verdicts(table(spark, sf_dir, "documents"))


@query()
def op2_suffix_dedup(spark, sf_dir):
    """Strings of 200 bytes that start in two places."""
    cut = remove_repeats(table(spark, sf_dir, "documents"), length=200, texts=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest
        FROM pages
    ), q AS (
        SELECT *, max(page_id) OVER (PARTITION BY digest) AS first_id FROM p
    )
    SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
           CASE WHEN size >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN size >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
    FROM q
    """
)
def op4_warc_transactions(spark, sf_dir):
    """Pages as WARC transactions, written, read back and assembled."""
    return round_trip(table(spark, sf_dir, "pages"))


@query(
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE [array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s
        FROM w
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), p AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s)
        WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
    ), e AS (
        SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 85 * (m.n + o.n - c)
    ), d AS (
        SELECT a, b FROM e UNION SELECT b, a FROM e
    ), r AS (
        SELECT doc_id AS x, doc_id AS y FROM documents
        UNION
        SELECT r.x, d.b FROM r JOIN d ON d.a = r.y
    )
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, min(y)) AS component_id,
           doc_id = least(doc_id, min(y)) AS kept
    FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.x = doc_id
    GROUP BY doc_id, n.n
    """
)
def op5_setsketch_near_duplicates(spark, sf_dir):
    """Components of documents that share 85 of 100 shingles of three words."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


@query()
def op7_simhash_decontamination(spark, sf_dir):
    """Passages of benchmark items in documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_temperature_mixing(spark, sf_dir):
    """Sources flattened as far as two repetitions allow; every document at least once."""
    return mixed(table(spark, sf_dir, "documents"), repeats=2.0)


@query()
def op10_compact_passages(spark, sf_dir):
    """Passages of 50 words and more that an earlier document has, nearly or exactly."""
    return near_passages(table(spark, sf_dir, "documents"))


@query()
def op3_kneser_ney_toxicity(spark, sf_dir):
    """Toxic against ordinary Kneser-Ney likelihoods of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_additive_quality(spark, sf_dir):
    """Quality of every document by lookup tables."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_brown_perplexity(spark, sf_dir):
    """Class-based log-probabilities of every document."""
    return perplexities(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE [array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s
        FROM w
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), p AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s)
        WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
    ), e AS (
        SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 85 * (m.n + o.n - c)
    ), d AS (
        SELECT a, b FROM e UNION SELECT b, a FROM e
    ), r AS (
        SELECT doc_id AS x, doc_id AS y FROM documents
        UNION
        SELECT r.x, d.b FROM r JOIN d ON d.a = r.y
    )
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, min(y)) AS component_id
    FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.x = doc_id
    GROUP BY doc_id, n.n
    """
)
def op11_overlap_join(spark, sf_dir):
    """Components of documents that share 85 of 100 shingles of four words."""
    return linked_documents(table(spark, sf_dir, "documents"), n=4, percent=85)


@query()
def op12_tokenizer_alignment(spark, sf_dir):
    """Byte-level and piece tokens of every document, aligned."""
    return align_tokenizers(
        table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
    )


@query(
    r"""
    WITH ids AS (
        SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL
    ), crc AS (
        -- CRC-32 bit by bit: the decimal's bytes, eight shifts for each
        SELECT c, xor(list_reduce(
            list_prepend(4294967295::BIGINT, flatten([
                list_concat([-1 - ascii(substr(CAST(c AS VARCHAR), k, 1))::BIGINT], [0::BIGINT FOR i IN range(8)])
                FOR k IN range(1, length(CAST(c AS VARCHAR)) + 1)])),
            lambda x, b: CASE WHEN b < 0 THEN xor(x, -1 - b)
                WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), 4294967295::BIGINT) AS crc
        FROM ids
    ), own AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
        FROM conversations WHERE conv_id IS NOT NULL
    ), turns AS (
        SELECT x.c, o.k, o.role, o.text FROM crc x JOIN own o ON o.c = x.c - x.c % 20 WHERE o.k <= x.crc % 4
        UNION ALL
        SELECT x.c, o.k, o.role, o.text FROM crc x JOIN own o ON o.c = x.c WHERE o.k > x.crc % 4
    ), rebuilt AS (
        SELECT ids.c, coalesce(list({'r': role, 't': text} ORDER BY k) FILTER (k IS NOT NULL), []) AS seq
        FROM ids LEFT JOIN turns ON turns.c = ids.c GROUP BY ids.c
    ), prefixes AS (
        SELECT c, seq AS whole, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt
    ), nodes AS (
        SELECT whole[1:depth] AS seq, depth, min(c) AS conv_id, count(*) AS n_convs,
               coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(whole) = depth), '') AS ends
        FROM prefixes GROUP BY 1, 2
    ), kids AS (
        SELECT seq[1:depth - 1] AS seq, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
    ), own_share AS (
        SELECT n.*, coalesce(k.n, 0) AS n_children,
               CASE WHEN depth = 0 THEN 0
                    ELSE (n_convs - 1) * len(regexp_extract_all(n.seq[depth]['t'], '[^ 	-]+')) END AS saved
        FROM nodes n LEFT JOIN kids k ON k.seq = n.seq
    ), ups AS (
        SELECT seq[1:d] AS seq, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
        FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own_share) GROUP BY 1
    )
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
           CAST(n.n_children AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves,
           CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM own_share n JOIN ups u ON u.seq = n.seq
    LEFT JOIN nodes p ON n.depth > 0 AND p.seq = n.seq[1:n.depth - 1]
    """
)
def op13_conversation_trie(spark, sf_dir):
    """Every node of the trie of conversations that share their first turns."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
