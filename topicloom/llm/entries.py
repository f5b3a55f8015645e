"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from .common import table


def op1_token_counts(spark, sf_dir):
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op2_token_store(spark, sf_dir):
    from .token_store import encode_and_index

    return encode_and_index(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    from .substring_dedup import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op4_topk_search(spark, sf_dir):
    from .topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark, sf_dir):
    from .jaccard_join import components

    return components(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    from .decontamination import find_hits

    return find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark, sf_dir):
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark, sf_dir):
    from .centroid_clustering import cluster

    return cluster(table(spark, sf_dir, "embeddings")).drop("n_exact")


def op12_warc(spark, sf_dir):
    from .warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark, sf_dir):
    from .periodic_runs import digests

    return digests(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pipeline": pipeline}


_TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) p from embeddings where embedding is not null),
s as (select q.vec_id query_id, c.vec_id, cast(list_dot_product(q.p, c.p) as bigint) score from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""


def oracle_sql():
    from . import centroid_clustering, decontamination, jaccard_join, warc

    return {"op11_centroid_clustering": centroid_clustering.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL, "op4_topk_search": _TOPK_SQL, "op5_jaccard_join": jaccard_join.ORACLE_SQL, "op9_decontamination": decontamination.ORACLE_SQL}
