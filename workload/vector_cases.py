"""Vector arithmetic, exact search, fusion of lists, similar items."""

from __future__ import annotations

from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.functions import scoring
from hayloft.operators import balls, fusion, vectors
from hayloft.plans import similar
from hayloft.plans.search import confidence_profile
from hayloft.session import broadcast_if_small, work_dir
from hayloft.sources import tables
from workload import lexical_cases as lex
from workload import views as v
from workload.registry import query, shown

K = 20
QUERY_ROWS = 100_000  # query vectors broadcast at once, about 0.3 KB each


def _asked(spark, sf, *kinds):
    qv = v.query_vectors(spark, sf, v.base_queries(spark, sf))
    return qv.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))


def _sims(spark, sf, *kinds, k=None):
    return vectors.similarity(v.text_vectors(spark, sf), _asked(spark, sf, *kinds), k)


def _clip(spark, sf, *kinds, k=None):
    asked = v.clip_query_vectors(spark, sf).withColumn("kind", F.explode(F.array(*[F.lit(x) for x in kinds])))
    return vectors.similarity(v.pixel_vectors(spark, sf), asked, k)


@query(
    "x8_dot_products",
    """select a.vec_id, b.item_id as query_id, round(list_dot_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) + 0.0 as score
       from embeddings a, benchmark b join embeddings e on e.vec_id = b.item_id where a.label = e.label""",
)
def dot_products(spark, sf):
    """Query vectors against the vectors of the same label, as a column expression."""
    vecs = v.table(spark, sf, "embeddings")
    queries = vecs.join(v.table(spark, sf, "benchmark"), F.col("item_id") == F.col("vec_id")).select(
        F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q")
    )
    # labels are few: a checked broadcast leaves the vectors where they lie, no label gathers in one task
    return vecs.join(broadcast_if_small(queries, QUERY_ROWS), "label").select("vec_id", "query_id", scoring.settled(scoring.dot(F.col("embedding"), F.col("q"))).alias("score"))


@query(
    "x9_unit_vectors",
    """select vec_id, unnest(range(len(u))) as pos, round(unnest(u), 9) + 0.0 as x from (
         select vec_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) as u
         from (select vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 2)) as w from embeddings))""",
)
def unit_vectors(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    unit = v.table(spark, sf, "embeddings").select("vec_id", F.posexplode(scoring.l2_normalize(scaled)).alias("pos", "x"))
    return unit.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 9).alias("x"))


@query("e1_text_embeddings", v.sql("select item_id, kind, unnest(range(64)) as dim, round(unnest(vec), 9) + 0.0 as x from text_vectors", "text_vectors"))
def text_embeddings(spark, sf):
    cells = v.text_vectors(spark, sf).select("item_id", "kind", F.posexplode("vec").alias("dim", "x"))
    return cells.select("item_id", "kind", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 9).alias("x"))


@query("e1_query_embeddings", v.sql("select query_id, unnest(range(64)) as dim, round(unnest(vec), 9) + 0.0 as x from query_vectors", "query_vectors"))
def query_embeddings(spark, sf):
    cells = v.query_vectors(spark, sf, v.base_queries(spark, sf)).select("query_id", F.posexplode("vec").alias("dim", "x"))
    return cells.select("query_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 9).alias("x"))


@query("j5_query_vector_products", v.sql("select query_id, kind, item_id, score from sims", "sims"))
def query_vector_products(spark, sf):
    return _sims(spark, sf, *S.KIND_TEXT_FIELD).unionByName(_clip(spark, sf, "C", "V"))


@query("v1_vector_search", v.sql("select query_id, item_id, score from sims where kind = 'D' qualify row_number() over (partition by query_id order by score desc, item_id) <= 20", "sims"))
def vector_search(spark, sf):
    return _sims(spark, sf, "D", k=K).drop("kind")


@query("a14_best_frames", v.sql("select query_id, item_id, score from sims where kind = 'V'", "sims"))
def best_frames(spark, sf):
    return _clip(spark, sf, "V").drop("kind")


@query("v2_multi_vector_search", v.sql("select query_id, item_id, score from sims where kind = 'V' qualify row_number() over (partition by query_id order by score desc, item_id) <= 20", "sims"))
def multi_vector_search(spark, sf):
    return _clip(spark, sf, "V", k=K).drop("kind")


@query("o3_top_k", v.sql("select query_id, kind, item_id, score, row_number() over (partition by query_id, kind order by score desc, item_id) as rank from sims where kind in ('D', 'T') qualify rank <= 10", "sims"))
def top_k(spark, sf):
    return fusion.rank(_sims(spark, sf, "D", "T"), ("query_id", "kind"), limit=10)


@query("o4_top_k_items", v.sql("select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank from sims where kind = 'V' qualify rank <= 5", "sims"))
def top_k_items(spark, sf):
    return fusion.rank(_clip(spark, sf, "V"), limit=5).drop("kind")


@query("v3_vectors_of_items", v.sql("select item_id, frame from store where kind = 'V' and item_id in (select item_id from benchmark)", "store"))
def vectors_of_items(spark, sf):
    return vectors.vector_of(v.store(spark, sf), v.table(spark, sf, "benchmark"), "V").select("item_id", "frame")


@query(
    "v4_upsert_vectors",
    v.sql(
        """, gone as (select doc_id as item_id from labels where toxic = 1),
           changed as (select item_id from benchmark)
           select item_id, kind, frame, 'kept' as origin from store
             where not (kind = 'C' and item_id in (from changed)) and not (kind in ('D', 'T', 'C') and item_id in (from gone))
           union all select vec_id, 'C', 0, 'new' from embeddings where vec_id in (from changed)""",
        "store",
    ),
)
def upsert_vectors(spark, sf):
    base = v.store(spark, sf).select("item_id", "kind", "frame", F.lit("kept").alias("origin"))
    new = v.clip_query_vectors(spark, sf).select(
        F.col("query_id").alias("item_id"), F.lit("C").alias("kind"), F.lit(0).alias("frame"), F.lit("new").alias("origin")
    )
    gone = v.table(spark, sf, "labels").where("toxic = 1").select(
        F.col("doc_id").alias("item_id"), F.explode(F.array(F.lit("D"), F.lit("T"), F.lit("C"))).alias("kind")
    )
    return vectors.upsert(base, new, gone)


@query("v5_single_semantic_modes", v.sql("select query_id, kind, item_id, score, row_number() over (partition by query_id, kind order by score desc, item_id) as rank from sims where kind in ('D', 'O', 'T')", "sims"))
def single_semantic_modes(spark, sf):
    return fusion.rank(_sims(spark, sf, "D", "O", "T"), ("query_id", "kind"), list_bound=lex.bound(spark, sf))


@query("v6_combined_semantic", v.sql("select query_id, item_id, score from semantic_list", "semantic_list"))
def combined_semantic(spark, sf):
    return fusion.max_weighted(_sims(spark, sf, "D", "O", "T"), S.TEXT_KIND_WEIGHTS, "kind")


@query(
    "v7_weighted_cross_field",
    v.sql(
        """, cut as (select *, case kind when 'D' then 0.7e0 else 0.3e0 end as w from sims where kind in ('D', 'T')
             qualify row_number() over (partition by query_id, kind order by score desc, item_id) <= 20)
           select query_id, item_id, arg_max(score, score * w) as score from cut group by all""",
        "sims",
    ),
)
def weighted_cross_field(spark, sf):
    qv = v.query_vectors(spark, sf, v.base_queries(spark, sf))
    return vectors.combined(v.text_vectors(spark, sf), qv, {"D": 0.7, "O": 0.0, "T": 0.3}, k=K)


@query("v8_clip_search", v.sql("select query_id, item_id, score from clip_list", "clip_list"))
def clip_search(spark, sf):
    return fusion.max_weighted(_clip(spark, sf, "C", "V"), S.CLIP_KIND_WEIGHTS, "kind")


@query("v9_caption_search", v.sql("select query_id, item_id, score from caption_list", "caption_list"))
def caption_search(spark, sf):
    lexical_list = lex.fields(spark, sf, fields=("caption",)).select("query_id", F.lit("lexical").alias("retriever"), "item_id", "score")
    semantic_list = _sims(spark, sf, "L").select("query_id", F.lit("semantic").alias("retriever"), "item_id", "score")
    return fusion.reciprocal_rank(
        lexical_list.unionByName(semantic_list), S.CAPTION_WEIGHTS, list_bound=lex.bound(spark, sf)
    )


# --- fusion ---------------------------------------------------------------------------------------


def _lists(spark, sf):
    """Lexical, semantic and clip lists of the plain queries."""
    parts = {
        "lexical": lex.lexical_list(spark, sf),
        "semantic": combined_semantic(spark, sf),
        "clip": clip_search(spark, sf),
    }
    from functools import reduce

    return reduce(
        lambda a, b: a.unionByName(b),
        [df.select("query_id", F.lit(name).alias("retriever"), "item_id", "score") for name, df in parts.items()],
    )


@query("u1_united_lists", v.sql("select distinct query_id, item_id from ranked_lists", "ranked_lists"))
def united_lists(spark, sf):
    return _lists(spark, sf).select("query_id", "item_id").distinct()


@query("w1_list_ranks", v.sql("select retriever, query_id, item_id, round(score + 3e-10, 6) as score, rank from ranked_lists", "ranked_lists"))
def list_ranks(spark, sf):
    return shown(fusion.rank(_lists(spark, sf), ("query_id", "retriever"), list_bound=lex.bound(spark, sf)))


@query("w1_list_ranks_spread", v.sql("select retriever, query_id, item_id, round(score + 3e-10, 6) as score, rank from ranked_lists", "ranked_lists"))
def list_ranks_spread(spark, sf):
    """The same ranks from counts, as for lists of unknown length."""
    return shown(fusion.spread_rank(_lists(spark, sf), ("query_id", "retriever"), id_span=64))


@query("f1_max_weighted", v.sql("select query_id, item_id, arg_max(score, score * w) as score from (select *, case kind when 'D' then 0.5e0 when 'O' then 0.3e0 else 0.2e0 end as w from sims where kind in ('D', 'O', 'T')) group by all", "sims"))
def max_weighted(spark, sf):
    return fusion.max_weighted(_sims(spark, sf, "D", "O", "T"), S.TEXT_KIND_WEIGHTS, "kind")


@query("f2_weighted_sum", v.sql("select query_id, item_id, round(sum(score * case kind when 'D' then 0.5e0 when 'O' then 0.3e0 else 0.2e0 end) + 3.7e-8, 4) + 0.0 as score from sims where kind in ('D', 'O', 'T') group by all", "sims"))
def weighted_sum(spark, sf):
    # sums of weighted nine-digit scores often end on a five in the later digits
    sums = fusion.weighted_sum(_sims(spark, sf, "D", "O", "T"), S.TEXT_KIND_WEIGHTS, "kind")
    return sums.withColumn("score", F.round(F.col("score") + 3.7e-8, 4))


@query("f3_reciprocal_rank", v.sql("select query_id, item_id, score from classic", "classic"))
def reciprocal_rank(spark, sf):
    return fusion.reciprocal_rank(_lists(spark, sf), S.HYBRID_WEIGHTS, list_bound=lex.bound(spark, sf))


@query("f4_confident_reciprocal_rank", v.sql("select query_id, item_id, score from hybrid", "hybrid"))
def confident_reciprocal_rank(spark, sf):
    from hayloft.operators import lexical

    profile = confidence_profile("en")
    lists = _lists(spark, sf).join(lexical.best_exact_match(lex.exact(spark, sf)), "query_id")
    confidence = (
        F.when(F.col("retriever") == "lexical", scoring.lexical_confidence(F.col("score"), F.col("exact_match")))
        .when(F.col("retriever") == "semantic", scoring.range_confidence(F.col("score"), *profile.semantic))
        .otherwise(scoring.range_confidence(F.col("score"), *profile.clip))
    )
    return fusion.reciprocal_rank(lists, S.HYBRID_WEIGHTS, confidence=confidence, list_bound=lex.bound(spark, sf))


@query("f5_lexical_confidence", v.sql("select query_id, item_id, round(conf + 3e-10, 6) as confidence from confident where retriever = 'lexical'", "confident"))
def lexical_confidence(spark, sf):
    from hayloft.operators import lexical

    best = lexical.best_exact_match(lex.exact(spark, sf))
    return lex.lexical_list(spark, sf).join(best, "query_id").select(
        "query_id", "item_id", F.round(scoring.lexical_confidence(F.col("score"), F.col("exact_match")) + 3e-10, 6).alias("confidence")
    )


@query("f6_range_confidence", v.sql("select retriever, query_id, item_id, round(conf + 3e-10, 6)::DOUBLE as confidence from confident where retriever <> 'lexical'", "confident"))
def range_confidence(spark, sf):
    profile = confidence_profile("en")
    lists = _lists(spark, sf).where("retriever <> 'lexical'")
    conf = F.when(F.col("retriever") == "semantic", scoring.range_confidence(F.col("score"), *profile.semantic)).otherwise(
        scoring.range_confidence(F.col("score"), *profile.clip)
    )
    return lists.select("retriever", "query_id", "item_id", F.round(conf + 3e-10, 6).alias("confidence"))


@query(
    "f7_confidence_profiles",
    v.sql(
        """select s.query_id, s.item_id, p.profile, round(case when score > hi then 1 else least(1, greatest(0, 0.5e0 + (score - lo) / (hi - lo)) * 0.5e0) end + 3e-10, 6)::DOUBLE as confidence
           from semantic_list s, (values ('en', 0.55e0, 0.70e0), ('pl_gpu', 0.15e0, 0.45e0), ('pl_cpu', 0.94e0, 0.96e0)) p(profile, lo, hi)""",
        "semantic_list",
    ),
)
def confidence_profiles(spark, sf):
    profiles = {"en": confidence_profile("en"), "pl_gpu": confidence_profile("pl", "gpu"), "pl_cpu": confidence_profile("pl", "cpu")}
    cells = [
        F.struct(F.lit(name).alias("profile"), F.round(scoring.range_confidence(F.col("score"), *p.semantic) + 3e-10, 6).alias("confidence"))
        for name, p in profiles.items()
    ]
    return combined_semantic(spark, sf).select("query_id", "item_id", F.explode(F.array(*cells)).alias("c")).select("query_id", "item_id", "c.*")


# --- similar items --------------------------------------------------------------------------------


def _seeds(spark, sf):
    return v.files(spark, sf).select(F.col("id").alias("seed_id"))


def _similar_sql(kind: str, column: str) -> str:
    """Every file as seed of a text kind. OCR texts are searched from screenshots only."""
    return v.sql(
        f""", seeds as (select id as seed_id, coalesce({column}, '') as text from files),
            found as (
              select a.seed_id, b.item_id, round(list_dot_product(sa.vec, b.vec), 9) + 0.0 as score
              from seeds a join store sa on sa.item_id = a.seed_id and sa.kind = '{kind}' and a.text <> '' join store b on b.kind = '{kind}'),
            cut as (select *, row_number() over (partition by seed_id order by score desc, item_id) as rank from found qualify rank <= 500)
            select seed_id, item_id, score, rank from cut
            union all select seed_id, seed_id, 1.0e0, 1 from seeds
              where text = '' or seed_id not in (select item_id from store where kind = '{kind}')""",
        "store", "files",
    )


@query("n1_similar_descriptions", _similar_sql("D", "description"))
def similar_descriptions(spark, sf):
    return similar.similar_text(v.files(spark, sf), v.text_vectors(spark, sf), _seeds(spark, sf), "D", 500)


@query("n1_similar_ocr_texts", _similar_sql("O", "ocr_text"))
def similar_ocr_texts(spark, sf):
    return similar.similar_text(v.files(spark, sf), v.text_vectors(spark, sf), _seeds(spark, sf), "O", 500)


@query("n1_similar_transcripts", _similar_sql("T", "transcript"))
def similar_transcripts(spark, sf):
    return similar.similar_text(v.files(spark, sf), v.text_vectors(spark, sf), _seeds(spark, sf), "T", 500)


_CAPTION_SEEDS = """, seeds as (select id as seed_id, coalesce(llm_description, '') as text from files)"""


@query(
    "n1_similar_captions",
    v.sql(
        _CAPTION_SEEDS
        + f""", cells as (select seed_id, {v._slot} as dim, sum({v._sign})::DOUBLE as v
                from (select seed_id, unnest({v.TOKENS.format('text')}) as token from seeds) group by all),
              made as ({v._embed('cells', 'seed_id')}),
              found as (select m.seed_id, s.item_id, round(list_dot_product(m.vec, s.vec), 9) + 0.0 as score from made m join store s on s.kind = 'L'),
              cut as (select *, row_number() over (partition by seed_id order by score desc, item_id) as rank from found qualify rank <= 500),
              missing as (select seed_id from seeds where text <> '' and seed_id not in (select item_id from store where kind = 'L'))
              select c.seed_id, item_id, score, rank + (c.seed_id in (from missing))::INT as rank from cut c
              union all select seed_id, seed_id, 1.0e0, 1 from missing
              union all select seed_id, seed_id, 1.0e0, 1 from seeds where text = ''""",
        "store", "files",
    ),
)
def similar_captions(spark, sf):
    """Captions that are not analysed yet have no stored vector: those seeds are embedded on the way."""
    return similar.similar_text(v.files(spark, sf), v.text_vectors(spark, sf), _seeds(spark, sf), "L", 500)


def _pictures_sql(kind: str) -> str:
    return v.sql(
        f""", found as (select a.item_id as seed_id, b.item_id, max(round(list_dot_product(a.vec, b.vec), 9) + 0.0) as score
              from pixel_vectors a join pixel_vectors b on a.kind = 'C' and b.kind = '{kind}' group by all)
            select *, row_number() over (partition by seed_id order by score desc, item_id) as rank from found qualify rank <= 500
            union all select id, id, 1.0e0, 1 from files where ftype <> 'image' or id not in (select item_id from pixel_vectors where kind = 'C')""",
        "pixel_vectors", "files",
    )


@query("n2_similar_images", _pictures_sql("C"))
def similar_images(spark, sf):
    return similar.similar_images(v.files(spark, sf), v.pixel_vectors(spark, sf), _seeds(spark, sf), 500)


@query("n3_similar_videos", _pictures_sql("V"))
def similar_videos(spark, sf):
    return similar.similar_images(v.files(spark, sf), v.pixel_vectors(spark, sf), _seeds(spark, sf), 500, kind="V")


@query(
    "n4_similar_to_upload",
    v.sql(
        """, found as (select q.query_id as seed_id, s.item_id, round(list_dot_product(q.vec, s.vec), 9) + 0.0 as score
             from clip_query_vectors q join pixel_vectors s on s.kind = 'C')
           select *, row_number() over (partition by seed_id order by score desc, item_id) as rank from found qualify rank <= 500""",
        "clip_query_vectors", "pixel_vectors",
    ),
)
def similar_to_upload(spark, sf):
    outside = v.clip_query_vectors(spark, sf).withColumnRenamed("query_id", "seed_id")
    return similar.similar_to_vectors(v.pixel_vectors(spark, sf), outside, 500)


_METADATA = f""", sources as (
    select id as seed_id, 0 as place, description as text from files where description <> ''
    union all select id, 1, ocr_text from files where ocr_text <> '' and ocr_text <> description
    union all select id, 2, transcript from files where transcript <> '' and transcript <> description),
  numbered as (select *, row_number() over (partition by seed_id order by place) - 1 as nth, count(*) over (partition by seed_id) as n from sources),
  cells as (select seed_id, nth, {v._slot} as dim, sum({v._sign})::DOUBLE as v
    from (select seed_id, nth, unnest({v.TOKENS.format('text')}) as token from numbered) group by all),
  made as ({v._embed('cells', 'seed_id, nth')}),
  found as (select m.seed_id, m.nth, s.kind, s.item_id, round(list_dot_product(m.vec, s.vec), 9) + 0.0 as score
    from made m join store s on s.kind in ('D', 'O', 'T')
    qualify row_number() over (partition by m.seed_id, m.nth, s.kind order by round(list_dot_product(m.vec, s.vec), 9) desc, s.item_id) <= 500),
  per_text as (select seed_id, nth, item_id, arg_max(score, score * case kind when 'D' then 0.5e0 when 'O' then 0.3e0 else 0.2e0 end) as score from found group by all),
  fused as (select seed_id, item_id, arg_max(score, score * case nth when 0 then 0.5e0 else 0.25e0 end) as score from per_text group by all),
  cut as (select f.* from fused f left join (select distinct seed_id, n from numbered) n using (seed_id)
    qualify row_number() over (partition by f.seed_id order by score desc, item_id) <= 500 or n.n = 1)
  select seed_id, item_id, score, 1 + row_number() over (partition by seed_id order by score desc, item_id) as rank from cut where item_id <> seed_id
  union all select id, id, 1.0e0, 1 from files"""


@query("n5_similar_metadata", v.sql(_METADATA, "store", "files"))
def similar_metadata(spark, sf):
    return similar.similar_metadata(v.files(spark, sf), v.text_vectors(spark, sf), _seeds(spark, sf), 500)


@query(
    "n6_neighbours",
    """select a.vec_id as seed_id, b.vec_id as item_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) + 0.0 as score,
         row_number() over (partition by a.vec_id order by round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) desc, b.vec_id) as rank
       from embeddings a, embeddings b qualify rank <= 10""",
)
def neighbours(spark, sf):
    store = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.lit("C").alias("kind"), F.col("embedding").alias("vec"))
    return similar.neighbours(store, "C", 10)


def _in_balls(vectors_of_kinds):
    root = work_dir(vectors_of_kinds.sparkSession, "ball-store")
    tables.write_balls(vectors_of_kinds, root)
    return tables.read_balls(vectors_of_kinds.sparkSession, root)


@query("v2_multi_vector_balls", v.sql("select query_id, item_id, score from sims where kind = 'V' qualify row_number() over (partition by query_id order by score desc, item_id) <= 20", "sims"))
def multi_vector_balls(spark, sf):
    """``v2_multi_vector_search`` by balls of frames."""
    asked = v.clip_query_vectors(spark, sf).withColumn("kind", F.lit("V"))
    return balls.nearest(_in_balls(v.pixel_vectors(spark, sf)), asked, K).drop("kind")


@query("v1_vector_balls", v.sql("select query_id, kind, item_id, score from sims where kind in ('D', 'O', 'T') qualify row_number() over (partition by query_id, kind order by score desc, item_id) <= 20", "sims"))
def vector_balls(spark, sf):
    """The best of three kinds of text by balls."""
    return balls.nearest(_in_balls(v.text_vectors(spark, sf)), _asked(spark, sf, "D", "O", "T"), K)


@query(
    "n6_neighbours_balls",
    """select a.vec_id as seed_id, b.vec_id as item_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) + 0.0 as score,
         row_number() over (partition by a.vec_id order by round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) desc, b.vec_id) as rank
       from embeddings a, embeddings b qualify rank <= 10""",
)
def neighbours_balls(spark, sf):
    """``n6_neighbours`` by balls."""
    store = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.lit("C").alias("kind"), F.col("embedding").alias("vec"))
    return similar.neighbours(_in_balls(store), "C", 10)


@query(
    "u3_self_first",
    v.sql(
        _CAPTION_SEEDS
        + """ select seed_id, seed_id as item_id, 1.0e0 as score, 1 as rank from seeds
              where text = '' or seed_id not in (select item_id from store where kind = 'L')""",
        "store", "files",
    ),
)
def self_first(spark, sf):
    found = similar.similar_text(v.files(spark, sf), v.text_vectors(spark, sf), _seeds(spark, sf), "L", 500)
    missing = _seeds(spark, sf).join(
        v.text_vectors(spark, sf).where("kind = 'L'").select(F.col("item_id").alias("seed_id")), "seed_id", "left_anti"
    )
    return found.join(missing, "seed_id", "left_semi").where("rank = 1")


@query("o5_similar_limit", v.sql("select a.item_id as seed_id, least(500, (select count(*) from pixel_vectors where kind = 'C')) as n from pixel_vectors a where kind = 'C'", "pixel_vectors"))
def similar_limit(spark, sf):
    seeds = v.pixel_vectors(spark, sf).where("kind = 'C'").select(F.col("item_id").alias("seed_id"))
    found = similar.similar_images(v.files(spark, sf), v.pixel_vectors(spark, sf), seeds, 500)
    return found.groupBy("seed_id").agg(F.count("*").alias("n"))
