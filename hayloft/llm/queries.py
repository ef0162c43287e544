"""Registered queries of the operators, each over its whole table, and the SQL to check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayloft.llm import chat_format, decontaminate, jaccard_join, langid, lm_score, mixing, pii, quality, runs, substrings, token_file, toxicity, vector_code
from hayloft.llm.common import stored, table, words

QUERIES = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")), vocabulary("piece_bpe_32k.model"))
    return langid.detect(docs, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op8_jaccard_join")
def jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


@query("op5_decontaminate")
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# positions of the shuffled streams; the mix takes each stream's words up to its quota, round by round, in
# blocks whose slots follow the golden-ratio sequence modulo a Fibonacci number
MIX_SQL = r"""
with recursive sizes as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) as size from documents),
totals as (select source, sum(size) as source_size from sizes group by source),
weighted as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from totals),
levels as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by 3 * source_size / weight, source nulls last rows between current row and unbounded following) as level from weighted),
shares as (select source, source_size, least((3 * source_size)::double, weight * max(level) over ()) as target from levels),
quotas as (select *, least(3 * source_size, floor(target + 0.5)) as quota from shares),
blocked as (select *, row_number() over (order by source nulls last) as number, ceil(quota / 256)::bigint as slots from quotas),
numbered as (select *, (sum(slots) over (order by number) - slots)::bigint as low from blocked),
placed as (select s.doc_id, s.size, q.source_size, q.target, q.quota,
    coalesce(sum(s.size) over (partition by s.source order by md5(coalesce(s.doc_id::varchar, '')), s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as start
    , q.number
    from sizes s join numbered q on s.source is not distinct from q.source),
fib as (select 1::hugeint as before, 1::hugeint as now union all select now, before + now from fib where now < (select coalesce(sum(slots), 0) from numbered)),
modulus as (select before, now, case when before * before % now = 1 % now then before else now - before end as inverse from fib order by now desc, before desc limit 1),
points as (select number, unnest(generate_series(low, low + slots - 1))::hugeint as point from numbered where slots > 0),
slots as (select number, slot, row_number() over (partition by number order by slot) - 1 as rank
    from (select number, (point * inverse % now)::bigint as slot from points, modulus)),
reach as (select *, size > 0 and start < quota as used, (start // 256)::bigint as first_rank,
    ((least(start + least(2, (quota::bigint - 1 - start) // greatest(source_size, 1)) * source_size + size, quota::bigint) - 1) // 256)::bigint as last_rank from placed)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
    (greatest(0, least(quota, start + size) - start) + greatest(0, least(quota, start + source_size + size) - start - source_size)
    + greatest(0, least(quota, start + 2 * source_size + size) - start - 2 * source_size))::bigint as taken,
    f.slot as first_slot, l.slot as last_slot
from reach p left join slots f on p.used and f.number = p.number and f.rank = p.first_rank
    left join slots l on p.used and l.number = p.number and l.rank = p.last_rank
"""


@query("op1_mixing", MIX_SQL)
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(table(spark, sf_dir, "documents"), lambda totals: mixing.cycled(totals, 1, 2, 3))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


@query("op4_token_file")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.written(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op2_quality")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.scored(docs, quality.ratios(docs, trusted))


@query("op6_chat_format")
def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], conversations.schema)
    return chat_format.digests(stored(chat_format.windows(conversations.unionByName(probe)), "windows"))


@query("op9_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(pii.labelled_table(docs))).drop("text")


@query("op3_toxicity")
def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    scored = toxicity.predict(docs, toxicity.train(docs, labels, ["low_quality", "toxic"])).drop("text")
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.3)


LM_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
places as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w),
t as (select doc_id, ws[i] as x, case when i > 1 then ws[i - 1] end as v from places),
uni as (select x, count(*) as n from t group by x),
bi as (select v, x, count(*) as n from t where v is not null group by v, x having count(*) >= 2),
s as (select t.doc_id, case when bi.n is not null then ln(bi.n / c.n) else ln(0.4 * u.n / (select count(*) from t)) end as p
    from t join uni u on t.x = u.x left join bi on bi.v = t.v and bi.x = t.x left join uni c on c.x = t.v)
select w.doc_id, count(s.p)::bigint as n_words, round(sum(s.p) / count(s.p), 6) as score from w left join s on w.doc_id = s.doc_id group by w.doc_id
"""


@query("op7_lm_score", LM_SQL)
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 6).alias("score"))


def _code_sql(rounds: int = 6) -> str:
    """Lloyd's method over whole vectors, round by round: no layers, no owners."""
    steps = [
        """kept as materialized (select row_number() over () as row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v
    from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        """parts as materialized (select row, vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] as part from kept, range(8) as t(p))""",
        """book0 as materialized (select p, rank - 1 as entry, part as center from (select *, row_number() over (partition by p order by vec_id) as rank from parts) where rank <= 16)""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} as materialized (select row, p, min(struct_pack(d := d, entry := entry)) as best from (select row, b.p, b.entry,
    list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - center[i]) * (part[i] - center[i])))::bigint as d from parts a join book{k} b on a.p = b.p) group by row, p)""")
        if k < rounds:
            steps.append(f"""book{k + 1} as materialized (with means as (select p, entry, list(floor(total / n)::bigint order by i) as center from (
    select a.p, best.entry as entry, i, sum(part[i])::double as total, count(*) as n from parts a join near{k} using (row, p), range(1, len(part) + 1) as t(i) group by all) group by p, entry)
    select b.p, b.entry, coalesce(m.center, b.center) as center from book{k} b left join means m on b.p = m.p and b.entry = m.entry)""")
    return "with " + ",\n".join(steps) + f""",
codes as (select row, string_agg(lower(printf('%02x', best.entry::int)), '' order by p) as code, sum(best.d)::bigint as error from near{rounds} group by row),
final as (select sha256(string_agg(c::varchar, ',' order by p, entry, i)) as codebooks_sha256 from (select p, entry, i, center[i] as c from book{rounds}, range(1, len(center) + 1) as t(i)))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join codes using (row), final
"""


@query("op13_vector_code", _code_sql())
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_code.compress(table(spark, sf_dir, "embeddings"))
    codes = vector_code.with_label_error(coded.codes).withColumn("codebooks_sha256", F.lit(vector_code.digest(coded.books)))
    return codes.select(F.col("key").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: in a tenth of the texts, chosen by the hash of the id, words from some place on repeat a block."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = words(F.col("text"))
    n, g = F.size(w).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    block = F.slice(w, (a + 1).cast("int"), p.cast("int"))
    again = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), again), F.lit(1), n.cast("int")), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(_with_planted_runs(table(spark, sf_dir, "documents")))
    best = runs.longest(F.col("runs"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SUBSTRING_SQL = r"""
with w as (select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
windows as (select row, doc_id, i, md5_number(array_to_string(ws[i:i + 19], ' ')) as passage from w, unnest(range(1, len(ws) - 18)) as t(i)),
again as (select row, i from (select row, i, row_number() over (partition by passage order by doc_id, i) as n from windows) where n > 1),
gone as (select distinct row, i + j as i from again, range(20) as t(j)),
places as (select row, i, ws[i] as word from w, unnest(range(1, len(ws) + 1)) as t(i)),
kept as (select row, string_agg(word, ' ' order by i) as kept, count(*) as n from places anti join gone using (row, i) group by row)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (row)
"""


@query("op12_substring_dedup", SUBSTRING_SQL)
def without_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
