"""The named queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterline.llm import collocations, conversations, debruijn, decontaminate, fingerprints, language, mixing, ngram_join, quality, sharding, suffix_array, token_counts, warc
from musterline.llm.tables import read, remainder, shared_folder


_HASH = "('0x' || substr(md5({}), 1, 15))::bigint"

_SHARDING = f"""
with recursive sized as (
  select doc_id, coalesce(strlen(text), 0)::bigint as bytes,
         {_HASH.format("coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')")} as hash
  from documents
), buckets as (
  select 0::bigint as prefix, 0 as depth, sum(bytes)::bigint as total from sized having count(*) > 0
  union all
  select x.prefix, x.depth, x.total from (
    select (s.hash >> (59 - b.depth)) as prefix, b.depth + 1 as depth, sum(s.bytes)::bigint as total
    from sized s join buckets b on b.total > {sharding.LIMIT} and b.depth < 60 and (s.hash >> (60 - b.depth)) = b.prefix
    group by 1, 2) x
)
select doc_id, substr(lpad(bin(hash), 60, '0'), 1, depth) as shard, depth, 0::bigint as page, bytes, bytes > {sharding.LIMIT} as oversized
from sized join buckets on (hash >> (60 - depth)) = prefix and (total <= {sharding.LIMIT} or depth = 60)
"""

_MIXING = f"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         {_HASH.format("'mix|' || coalesce(doc_id::varchar, '')")} as h
  from documents
), sources as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source collate C nulls last) - 1) % 3 + 1)::int]::double as w
  from docs group by source
), ordered as (
  select *, sum(w) over (order by 2 * source_size / w desc, source nulls last rows between unbounded preceding and current row) as w_rest,
         1.5 * sum(source_size) over ()
           - coalesce(sum(2 * source_size) over (order by 2 * source_size / w, source desc nulls first rows between unbounded preceding and 1 preceding), 0) as t_rest
  from sources
), level as (
  select max(t_rest / w_rest) filter (t_rest / w_rest * w <= 2 * source_size) as unit from ordered
), goals as (
  select source, source_size, least(2.0 * source_size, coalesce(unit * w, 2.0 * source_size)) as target from sources, level
), summed as (
  select d.*, g.source_size, g.target, floor(g.target)::bigint as quota,
         sum(d.size) over (partition by d.source order by d.h, d.doc_id rows between unbounded preceding and current row) - d.size as before
  from docs d join goals g on d.source is not distinct from g.source
)
select doc_id, size, source_size, round(target, 3) as target,
       case when source_size = 0 then 0
            else size * (quota // source_size) + greatest(0, least(size, quota % source_size - before)) end::bigint as taken
from summed
"""

_FOLDED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_RUNS = "list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' ')))"

# Shingles of five words; fewer words are one shingle.
_SHINGLES = f"case when len(w) >= 5 then {_RUNS.format(k=5)} when len(w) > 0 then [array_to_string(w, ' ')] else [] end"

_NGRAM_JOIN = f"""
with recursive words as (
  select doc_id, {_WORDS.format(_FOLDED.format('text'))} as w from documents
), sets as (
  select doc_id, {_SHINGLES} as s from words
), shingles as (
  select doc_id, len(s) as n, unnest(s) as s from sets
), links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached as (
  select doc_id as a, doc_id as b from sets
  union
  select r.a, l.b from reached r join (select a, b from links union select b, a from links) l on l.a = r.b
)
select doc_id, len(s)::bigint as n_shingles, component_id
from sets join (select a, min(b) as component_id from reached group by a) on a = doc_id
"""

_DECONTAMINATE = f"""
with words as (
  select doc_id, {_WORDS.format(_FOLDED.format('text'))} as w from documents
), items as (
  select item_id, w, {_SHINGLES} as s from (select item_id, {_WORDS.format(_FOLDED.format('text'))} as w from benchmark)
), wanted as (
  select item_id, len(s) as n, least(len(w), 5) as k, unnest(s) as s from items
), grams as (
  select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as s
  from words, (select distinct k from wanted) where len(w) >= k
)
select doc_id, item_id, n::bigint as n_shingles, count(*)::bigint as n_found
from wanted join grams using (k, s) group by doc_id, item_id, n having 100 * count(*) >= 75 * n
"""

_DEBRUIJN = f"""
with words as (
  select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents
), windows as (
  select doc_id, unnest(range(1, len(w) - 33)) as i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i : i + 34], ' ')))) as h
  from words where len(w) >= 35
), covered as (
  select distinct doc_id, unnest(range(i, i + 35)) as i from windows where h in (select h from windows group by h having count(*) > 1)
), placed as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words
), kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by i) as text from placed anti join covered using (doc_id, i) group by doc_id
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from words left join kept using (doc_id)
"""

_RULE = collocations.Rule()

_COLLOCATIONS = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
  select lang, sum(len(w))::hugeint as n from words group by lang
), counted as (
  select lang, phrase, count(*)::hugeint as a from (
    select lang, array_to_string(w[i : i + k - 1], ' ') as phrase
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, {_RULE.longest + 1}) t(k) where len(w) >= k)
  ) group by lang, phrase having count(*) >= {_RULE.least}
), candidates as (
  select lang, phrase, string_split(phrase, ' ') as w, a from counted where contains(phrase, ' ')
), covered as (
  select lang, array_to_string(w[1 : len(w) - 1], ' ') as phrase, a from candidates union select lang, array_to_string(w[2 : len(w)], ' '), a from candidates
), cuts as (
  select c.lang, c.phrase, c.a, k, h.a as l, t.a as r, n, (1000 * c.a * n) // (h.a * t.a) as score
  from (select *, unnest(range(1, len(w))) as k from candidates anti join covered using (lang, phrase, a)) c
  join counted h on h.lang = c.lang and h.phrase = array_to_string(w[1 : k], ' ')
  join counted t on t.lang = c.lang and t.phrase = array_to_string(w[k + 1 : len(w)], ' ')
  join totals s on s.lang = c.lang
), lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase collate C) as rank from lowest)
where rank <= {_RULE.top}
"""

_CONVERSATIONS = r"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
  from conversations
), summed as (
  select *, xor(list_reduce(list_transform(string_split(name, ''), lambda x: ord(x)::bigint), lambda c, b:
              list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), 4294967295), 4294967295) % 20 as kind
  from named
), damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from summed where kind <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
         lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text, copy) as before
  from damaged
), rows as (
  select *, left(role, 1) as initial,
         case when not regexp_matches(text, '[^ 	-
]') then 'B' when seen > 1 then 'D' when not regexp_matches(text, '[.!?][ 	-
]*$') then 'T' else '' end as fault
  from placed
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'B') as blank,
         count(*) filter (fault = 'D') as duplicate, count(*) filter (fault = 'T') as truncated,
         count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from rows group by conv_id
), inserts(q, to_q, price, letters, said) as (
  values (0, 0, 0, '', []::varchar[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
         (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
         (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])
), says(q, initial, to_q) as (
  values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), edits as (
  select r.conv_id, r.i, q.q, q.q as to_q, 2 as price, 'D' as letter, []::varchar[] as said from rows r, (values (0), (1), (2), (3)) q(q)
  union all
  select r.conv_id, r.i, s.q, s.to_q, case when r.initial = s.initial then 0 else 1 end + case when fault = 'T' then 5 else 0 end,
         case when r.initial = s.initial then 'K' else 'R' end,
         [case when r.initial = s.initial then role when s.initial = 'u' then 'user' else 'assistant' end || ':' || text]
  from rows r, says s where fault in ('', 'T') and (r.initial = s.initial or s.initial <> 's')
), walk as (
  select conv_id, 0::bigint as i, 0 as q, {'cost': 0, 'audit': '', 'said': []::varchar[]} as best from facts
  union all
  select x.conv_id, x.i, x.q, x.best from (
    select w.conv_id, e.i, e.to_q as q, min({'cost': w.best.cost + p.price + e.price, 'audit': w.best.audit || p.letters || e.letter, 'said': list_concat(list_concat(w.best.said, p.said), e.said)}) as best
    from walk w join inserts p on p.q = w.q join edits e on e.conv_id is not distinct from w.conv_id and e.i = w.i + 1 and e.q = p.to_q
    group by w.conv_id, e.i, e.to_q) x
), done as (
  select f.conv_id, min({'cost': w.best.cost + p.price, 'audit': w.best.audit || p.letters, 'said': list_concat(w.best.said, p.said)}) as best
  from facts f join walk w on w.conv_id is not distinct from f.conv_id and w.i = f.n join inserts p on p.q = w.q and p.to_q in (0, 3) group by f.conv_id
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit,
       sha256(coalesce(array_to_string(best.said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join facts f on f.conv_id is not distinct from c.conv_id left join done d on d.conv_id is not distinct from c.conv_id
"""

_WARC = """
with hashed as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), grouped as (
  select *, min(page_id) over (partition by hex, payload_bytes) as first from hashed
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest,
       case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from grouped
"""


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.ngram_join(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.documents.select("doc_id", "n_shingles", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.select("doc_id", F.col("quality").alias("label")).where(remainder(F.col("doc_id"), 4) != 2))
    scored = docs.select("doc_id", quality.scorer(spark, model)(F.col("text")).alias("score"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_array.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *sharding.NAMES)


def op6_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = debruijn.compact(read(spark, sf_dir, "documents")).kept
    return kept.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = language.learn(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = read(spark, sf_dir, "documents").select("text")
    return token_counts.histogram(text.select(token_counts.lengths()(F.col("text")).alias("length")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), F.array("source"))
    sources = mix.sources.withColumnRenamed("source", "named")
    joined = mix.documents.join(sources, F.col("source").eqNullSafe(F.col("named")), "left")
    return joined.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), _RULE)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations")
    repaired = conversations.repair(conversations.damage(given), given)
    totals = repaired.totals.withColumnRenamed("conv_id", "named")
    return repaired.digests().join(totals, F.col("conv_id").eqNullSafe(F.col("named"))).drop("named")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(read(spark, sf_dir, "pages"), folder)
    found = warc.verified(warc.read(spark, folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ngram_join": op1_ngram_join, "op2_quality": op2_quality, "op3_suffix_array": op3_suffix_array, "op4_decontaminate": op4_decontaminate, "op5_sharding": op5_sharding, "op6_debruijn": op6_debruijn, "op7_language": op7_language, "op8_token_counts": op8_token_counts, "op9_fingerprints": op9_fingerprints, "op10_mixing": op10_mixing, "op11_collocations": op11_collocations, "op12_conversations": op12_conversations, "op13_warc": op13_warc}


def statements() -> dict[str, str]:
    return {"op1_ngram_join": _NGRAM_JOIN, "op4_decontaminate": _DECONTAMINATE, "op5_sharding": _SHARDING, "op6_debruijn": _DEBRUIJN, "op10_mixing": _MIXING, "op11_collocations": _COLLOCATIONS, "op12_conversations": _CONVERSATIONS, "op13_warc": _WARC}
