"""Dictionary jobs, transcript quality, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hayloft.operators import dictionary, prompts, quality
from hayloft.session import checkpointed
from workload import views as v
from workload.registry import query

# DuckDB's levenshtein counts bytes. The data's few letters outside ASCII are mapped one to one to
# unused single-byte characters first, so that its bytes are our characters.
_WIDE = "éèñßêíçóöüäÍÉÇÈÑÖÓÜÄÊ"
_NARROW = "".join(map(chr, [*range(1, 9), *range(14, 27)]))


def _bytes(column: str) -> str:
    return f"translate({column}, '{_WIDE}', '{_NARROW}')"


_NEAR = f""", slim as (select lang, word, freq, {_bytes('word')} as b, length(word) as n from dictionary)"""
_DELETIONS = """, asked as (select lang, word, {0} as b, length(word) as n from query_words)"""
_PAIRS = _NEAR + _DELETIONS.format(_bytes("word")) + """, near as (
    select q.lang, q.word, d.word as candidate, d.freq, levenshtein(q.b, d.b) as distance
    from asked q join slim d on d.lang = q.lang and d.n between q.n - 2 and q.n + 2 where levenshtein(q.b, d.b) <= 2)"""


def _words_and_dictionary(spark, sf):
    """Query words and dictionary; the words of the documents are counted once for all places that read them."""
    counts = checkpointed(v.word_counts(spark, sf))
    return checkpointed(v.query_words(spark, sf, counts)), checkpointed(v.dictionary(spark, sf, counts))


@query("j6_near_words", v.sql(_PAIRS + " select lang, word, candidate, distance::INT as distance from near", "dictionary", "query_words"))
def near_words(spark, sf):
    return dictionary.near_words(*_words_and_dictionary(spark, sf), 2).select("lang", "word", "candidate", "distance")


@query(
    "j7_longest_prefix",
    v.sql(
        """, prefixes as (select distinct lang, substr(word, 1, n) as prefix from (select lang, word, unnest(range(length(word) + 1)) as n from dictionary)),
             starts as (select lang, word, n, substr(word, 1, n) as prefix from (select lang, word, unnest(range(length(word) + 1)) as n from word_counts))
           select s.lang, s.word, s.word in (select word from dictionary d where d.lang = s.lang) as is_known, max(case when p.prefix is not null then n else 0 end)::INT as prefix_length
           from starts s left join prefixes p on p.lang = s.lang and p.prefix = s.prefix group by s.lang, s.word""",
        "dictionary", "word_counts",
    ),
)
def longest_prefix(spark, sf):
    """Every word of the documents against the dictionary of frequent ones."""
    return dictionary.longest_prefix(v.word_counts(spark, sf).select("lang", "word"), v.dictionary(spark, sf))


@query(
    "j8_next_characters",
    v.sql(
        """select lang, prefix, string_agg(c, '' order by c) as next_chars from (
             select distinct lang, substr(word, 1, n) as prefix, substr(word, n + 1, 1) as c from (select lang, word, unnest(range(length(word))) as n from dictionary))
           group by all""",
        "dictionary",
    ),
)
def next_characters(spark, sf):
    return dictionary.next_characters(v.dictionary(spark, sf))


_UNKNOWN = _PAIRS + """, unknown as (select lang, word from query_words anti join slim using (lang, word)),
  fixes as (select lang, word, candidate, distance, round(ln(freq), 9) as score from near
    semi join unknown using (lang, word) where distance = 1 or (distance = 2 and length(word) >= 4)
    qualify row_number() over (partition by lang, word order by round(ln(freq), 9) desc, distance, candidate) = 1)"""


@query(
    "e5_corrections",
    v.sql(_UNKNOWN + " select lang, word, candidate, distance::INT as distance, score from fixes", "dictionary", "query_words"),
)
def corrections(spark, sf):
    return dictionary.corrections(*_words_and_dictionary(spark, sf))


_SPLITS = _UNKNOWN + f""", cuts as (select lang, word, cut, substr(word, 1, cut) as first, substr(word, cut + 1) as second
    from (select lang, word, unnest(range(2, length(word) - 2)) as cut from unknown where length(word) >= 5)),
  parts as (select lang, first as part from cuts union select lang, second from cuts),
  other as (select lang, part, {_bytes('part')} as b, length(part) as n from parts anti join slim on slim.lang = parts.lang and slim.word = parts.part),
  close as (select p.lang, p.part, d.word, ln(d.freq) as s from other p join slim d on d.lang = p.lang and d.n between p.n - 1 and p.n + 1
    where levenshtein(p.b, d.b) = 1
    qualify row_number() over (partition by p.lang, p.part order by round(ln(d.freq), 9) desc, d.word) = 1),
  usable as (select p.lang, p.part, p.part as word, ln(d.freq) as s from parts p join slim d on d.lang = p.lang and d.word = p.part union all from close),
  halves as (select c.lang, c.word, a.word as first, b.word as second, round(a.s + b.s, 9) as score from cuts c
    join usable a on a.lang = c.lang and a.part = c.first join usable b on b.lang = c.lang and b.part = c.second
    qualify row_number() over (partition by c.lang, c.word order by round(a.s + b.s, 9) desc, cut) = 1)"""


@query("e6_splits", v.sql(_SPLITS + " select lang, word, first, second, score from halves", "dictionary", "query_words"))
def splits(spark, sf):
    return dictionary.splits(*_words_and_dictionary(spark, sf))


@query(
    "e6_repaired_words",
    v.sql(
        _SPLITS
        + """ select q.lang, q.word, case when h.score is not null and (f.score is null or h.score > f.score) then h.first || ' ' || h.second
                else coalesce(f.candidate, q.word) end as replacement
              from query_words q left join fixes f on f.lang = q.lang and f.word = q.word left join halves h on h.lang = q.lang and h.word = q.word""",
        "dictionary", "query_words",
    ),
)
def repaired(spark, sf):
    return dictionary.repaired(*_words_and_dictionary(spark, sf))


def _words(column):
    return f"list_filter(regexp_split_to_array({column}, '\\s+'), lambda w: w <> '')"


# a walk over the reference words; ``line`` holds the distances of what was walked to each start of the hypothesis,
# and a start's distance is the least of an earlier start's plus the words between
_WALK = f"""with recursive spoken as (select id, {_words('ref')} as r, {_words('hyp')} as h from pairs),
  walk as (select id, 0 as i, range(0, len(h) + 1) as line from spoken
    union all select id, i + 1, list_transform(range(1, len(h) + 2), lambda j: j + list_min(list_transform(step[1:j], lambda s, k: s - k)))
    from (select w.id, w.i, s.h, list_transform(w.line, lambda d, k: case when k = 1 then w.i + 1
            else least(d + 1, w.line[k - 1] + case when s.h[k - 1] = s.r[w.i + 1] then 0 else 1 end) end) as step
          from walk w join spoken s on s.id = w.id where w.i < len(s.r)))
  select sum(w.line[len(s.h) + 1])::BIGINT as edits, sum(len(s.r))::BIGINT as n_ref,
    round(sum(w.line[len(s.h) + 1]) / sum(len(s.r)), 9) as rate
  from spoken s join walk w on w.id = s.id and w.i = len(s.r)"""


@query("a9_word_error_rate", v.sql(f"select * from ({_WALK})", "pairs"))
def word_error_rate(spark, sf):
    rate = quality.error_rate(quality.word_errors(v.pairs(spark, sf)))
    return rate.withColumn("rate", F.round("rate", 9))


@query(
    "a10_character_error_rate",
    v.sql(
        f"""select conv_id, sum(edits)::BIGINT as edits, sum(n_ref)::BIGINT as n_ref, round(sum(edits) / sum(n_ref), 9) as rate from (
              select conv_id, levenshtein({_bytes('ref')}, {_bytes('hyp')}) as edits, length(ref) as n_ref from pairs) group by conv_id""",
        "pairs",
    ),
)
def character_error_rate(spark, sf):
    pairs = v.pairs(spark, sf)
    errors = quality.character_errors(pairs).join(pairs.select("id", "conv_id"), "id")
    return quality.error_rate(errors, ("conv_id",)).withColumn("rate", F.round("rate", 9))


_TURNS = "select *, row_number() over (partition by conv_id order by turn) - 1 as i from conversations"


@query(
    "e3_prompts",
    f"""select conv_id, 'Be brief.' || chr(10) || chr(10) || string_agg(case when text <> '' then role || ': ' || text || case when i % 2 = 0 then chr(10) || chr(10) else '</s>' end
          else role || ':' end, '' order by i) as prompt from ({_TURNS}) group by conv_id""",
)
def prompt_strings(spark, sf):
    return prompts.prompts(v.table(spark, sf, "conversations"), system="Be brief.")


@query(
    "e3_plain_prompts",
    f"""select conv_id, string_agg(case when text <> '' then text || case when i % 2 = 0 then chr(10) || chr(10) else '</s>' end else '' end, '' order by i) as prompt
        from ({_TURNS}) group by conv_id""",
)
def plain_prompts(spark, sf):
    return prompts.prompts(v.table(spark, sf, "conversations"), style="plain")


@query(
    "e3_alignment_prompts",
    f"""select conv_id, string_agg(case when text = '' then '' when i % 2 = 0 then '<image>' || chr(10) || chr(10) || chr(10) else text || '</s>' end, '' order by i) as prompt
        from ({_TURNS}) group by conv_id""",
)
def alignment_prompts(spark, sf):
    return prompts.prompts(v.table(spark, sf, "conversations"), style="alignment")


@query(
    "e3_instruct_prompts",
    f"""select conv_id, '[INST] ' || string_agg(case when i = 0 then text || ' '
          else case when i % 2 = 0 then '[INST]' else '[/INST]' end || ' ' || text || case when i % 2 = 0 then chr(10) || chr(10) else '</s>' end end, '' order by i) as prompt
        from ({_TURNS}) group by conv_id""",
)
def instruct_prompts(spark, sf):
    return prompts.prompts(v.table(spark, sf, "conversations"), style="instruct")


@query(
    "e4_chat_messages",
    f"""select conv_id, 'system=You see pictures.|' || string_agg(case when i % 2 = 0 then 'user' else 'assistant' end || '=' || text, '|' order by i) as messages
        from ({_TURNS}) group by conv_id""",
)
def chat_messages(spark, sf):
    rows = prompts.chat_messages(v.table(spark, sf, "conversations"), "You see pictures.")
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return rows.select("conv_id", F.array_join(shown, "|").alias("messages"))
