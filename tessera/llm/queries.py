"""The registered queries of this subpackage: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .embedding_dedup import embedding_components
from .fill_in_middle import fill_in_middle, restored
from .impact_search import exact_top_k
from .language_id import identify_languages
from .line_dedup import drop_repeated_lines
from .lm_scoring import score_documents
from .mixing import mix_sources
from .packing import pack_conversations, pack_documents
from .quality_rules import quality_verdicts
from .secrets import secret_digest
from .simhash import simhash_components
from .sort_means import cluster_report
from .substring_dedup import drop_repeated_passages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the byte-level BPE vocabulary on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Target weights of the registered mix: every other source has weight 1, so src0 gets four blocks for one of another's.
TARGETS = {"src0": 4.0}


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), TARGETS, other=1.0)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_start", "on_target")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.filter("vec_id % 50 = 0"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of op10 for instruction data, where all three limits bind: whole conversations of the conversations table."""
    return pack_conversations(table(spark, sf_dir, "conversations"), vocabulary())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_line_dedup, op3_embedding_dedup, op4_lm_scoring, op5_language_id, op6_simhash, op7_secret_scan,
    op8_substring_dedup, op9_quality_rules, op10_packing, op11_centroid_clustering, op12_fill_in_middle, op13_exact_top_k, conversation_packing, pipeline,
)}

def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds written out: every vector against every centroid, in long form (a row for each component)."""
    steps = [f"""
        WITH p AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS double)) AS bigint)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        e AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(x) AS v FROM p),
        c0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS v FROM (
            SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS varchar))) - 1 AS c, x FROM p QUALIFY c < {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, CAST(sum((e.v - c.v) * (e.v - c.v)) AS bigint) AS d FROM e JOIN c{r} AS c ON e.i = c.i GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""
        m{r} AS (SELECT c, i, CAST(sum(v) AS bigint) AS s, count(*) AS n FROM a{r} JOIN e ON e.vec_id = a{r}.vec_id GROUP BY ALL),
        c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, o.v) AS v FROM c{r} AS o LEFT JOIN m{r} AS m ON m.c = o.c AND m.i = o.i)""")
    last = f"""
        SELECT vec_id, CAST(a.c AS integer) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS bigint) AS cluster_inertia, CAST(sum(d) OVER () AS bigint) AS inertia, sha AS centroid_sha256
        FROM a{rounds} AS a JOIN (SELECT c, sha256(string_agg(CAST(v AS varchar), ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c) AS h ON h.c = a.c"""
    return ",".join(steps) + last


#: SQL for DuckDB. The other operators need hashes, models, tokenizers or closures that SQL doesn't express; the tests hold them
#: against brute-force versions.
ORACLES: dict[str, str] = {
    "op11_centroid_clustering": _clustering_sql(),
    "op12_fill_in_middle": r"""
        WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS a, sha256('7:' || CAST(doc_id AS varchar)) AS h FROM documents),
        v AS (SELECT *, CAST(len(a) AS bigint) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, 1 + 8 * i, 8) AS bigint)) AS k FROM u),
        w AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS x, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS y,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 100 THEN 'plain' WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM v),
        p AS (SELECT *, array_to_string(a[1:x], '') AS pre, array_to_string(a[x + 1:y], '') AS mid, array_to_string(a[y + 1:n], '') AS suf FROM w)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
            sha256(t) AS restored_sha256 FROM p""",
    "op13_exact_top_k": """
        WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS bigint) AS score FROM f q JOIN f c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_line_dedup": r"""
        WITH l AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        x AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: regexp_matches(a[i], '[^\x20\x09-\x0D]')) AS full_ FROM l),
        r AS (SELECT doc_id, k, a[full_[k]] || chr(10) || a[full_[k + 1]] AS run FROM x, unnest(range(1, len(full_))) u(k)),
        f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS n FROM r),
        g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM f, unnest([k, k + 1]) v(j) WHERE n > 1 GROUP BY doc_id)
        SELECT x.doc_id, len(full_) AS n_lines, coalesce(len(gone), 0) AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN t ELSE array_to_string(list_transform(list_filter(range(1, len(a) + 1),
                   lambda i: NOT list_contains(list_transform(gone, lambda j: full_[j]), i)), lambda i: a[i]), chr(10)) END) AS kept_sha256
        FROM x LEFT JOIN g ON g.doc_id = x.doc_id""",
    "op8_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
        p AS (SELECT doc_id, k, array_to_string(a[k:k + 49], ' ') AS s FROM w, unnest(range(1, len(a) - 48)) u(k)),
        m AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS least FROM p),
        g AS (SELECT DISTINCT doc_id, k + o AS j FROM m, unnest(range(0, 50)) v(o) WHERE least < doc_id),
        e AS (SELECT doc_id, j, a[j] AS word FROM w, unnest(range(1, len(a) + 1)) u(j)),
        k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS kept, count(*) AS n FROM e ANTI JOIN g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY e.doc_id)
        SELECT w.doc_id, len(a) AS n_words, len(a) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
}
