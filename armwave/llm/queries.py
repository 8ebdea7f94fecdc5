"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armwave.llm import infill, jaccard, languages, licences, lm, mixing, negatives, pieces, quality, suffixes, tokencount, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return add


@_query("op7_quality_rules", r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
m as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
p as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from m where len(w) >= 3)),
c as (select doc_id, unnest([i, i+1, i+2]) as i from (select *, count(*) over (partition by doc_id, g) as k from p) where k >= 2),
r as (select doc_id, count(distinct i) as n_repeat_words from c group by doc_id),
b as (select m.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(lines) as bigint) as n_lines,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  cast(len(regexp_extract_all(text, '!')) as bigint) as n_exclaims,
  cast(len(regexp_extract_all(text, '[A-Z]')) as bigint) as n_capitals,
  cast(len(regexp_extract_all(text, '[A-Za-z]')) as bigint) as n_letters
  from m left join r using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  cast((case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
  + (case when 100 * n_symbols > 10 * n_words then 4 else 0 end) + (case when 100 * n_exclaims > 20 * n_words then 8 else 0 end)
  + (case when n_letters > 0 and 100 * n_capitals > 60 * n_letters then 16 else 0 end)
  + (case when 100 * n_dup_lines > 30 * n_lines then 32 else 0 end)
  + (case when word_chars > 15 * n_words or word_chars < 2 * n_words then 64 else 0 end) as bigint) as fail_bits from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits & 31 = 0 as kept, fail_bits from f""")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents and the verdict of policy prose-1."""
    rows = quality.measure(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality.verdict("base-1")).alias("base_failed"), quality.verdict("prose-1").alias("kept"), "fail_bits")


@_query("op4_ngram_jaccard", r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
r as (select doc_id as x, doc_id as root from documents union select l.y, r.root from r join l on l.x = r.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from documents d left join n using (doc_id)
join (select x as doc_id, min(root) as component_id from r group by x) c using (doc_id)""")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by five-word shingle similarity of 0.8 or more."""
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def _op10_follows(place: str) -> str:
    return f"substr(x, cast(2 * ({place}) + 1 as bigint), 1) in ('8', '9', 'A', 'B')"


def _op10_steps(place: str, step: int) -> str:
    """How many code-point bytes a cut at this byte moves to keep code points whole."""
    return (f"case when {_op10_follows(place)} then case when {_op10_follows(f'{place} + {step}')} then case when {_op10_follows(f'{place} + {2 * step}')}"
            " then 3 else 2 end else 1 end else 0 end")


@_query("op10_suffix_dedup", r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
p as (select doc_id, unnest(range(0, strlen(x) // 2 - 399)) as p, unnest(list_transform(range(0, strlen(x) // 2 - 399),
  lambda i: md5_number_lower(array_slice(x, 2 * i + 1, 2 * i + 800)))) as h from b where strlen(x) >= 800),
r as (select doc_id, p from (select doc_id, p, count(*) over (partition by h) as k from p) where k > 1),
g as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 400 then 0 else 1 end as new from r),
s as (select doc_id, min(p) as s, max(p) + 400 as e from (select *, sum(new) over (partition by doc_id order by p) as k from g) group by doc_id, k),
c as (select b.doc_id, x, s, e, s + """ + _op10_steps("s", 1) + " as cs, e - " + _op10_steps("e", -1) + r""" as ce from s join b using (doc_id)),
l as (select *, lag(e, 1, 0) over w as done, lag(ce, 1, 0) over w as cdone from c window w as (partition by doc_id order by s)),
k as (select doc_id, cast(sum(e - s) as bigint) as n_removed, count(*) as n_spans,
  string_agg(substr(x, cast(2 * done + 1 as bigint), cast(2 * (s - done) as bigint)), '' order by s) || substr(any_value(x), cast(2 * max(e) + 1 as bigint)) as kept,
  string_agg(substr(x, cast(2 * cdone + 1 as bigint), cast(2 * (cs - cdone) as bigint)), '' order by s) || substr(any_value(x), cast(2 * max(ce) + 1 as bigint)) as whole
  from l group by doc_id)
select b.doc_id, cast(strlen(x) // 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, x))) as kept_sha256, decode(unhex(coalesce(whole, x))) as kept_text from b left join k using (doc_id)""")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 400-byte strings that start more than once; ``kept_text`` leaves cut code points whole."""
    out = suffixes.cut(_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.decode("whole", "UTF-8").alias("kept_text"))


_OP9_LEVELS = "".join(f"""
u{i + 1} as (select sk, block, pass, node * 2 + case when 2 * row_number() over (partition by node order by md5('9u{i}|' || sk || '|' || block || '|' || pass))
  > count(*) over (partition by node) + node % 2 then 1 else 0 end as node from u{i}),""" for i in range(3))


@_query("op9_mixing", r"""
with recursive y as (select doc_id, coalesce('=' || source, '') as sk, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
  md5('9|' || coalesce(cast(doc_id as varchar), '-') || '|' || md5(coalesce('=' || source, '')) || '|' || md5(coalesce(text, ''))) as h from documents),
z as (select * exclude (h), md5('9n|' || h || '|' || row_number() over (partition by h)) as h from y),
s as (select sk, cast(sum(size) as bigint) as source_size, count(*) as n from z group by sk),
k as (select *, row_number() over (order by sk = '', sk) as rank from s),
w as (select *, case (rank - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from k),
v as (select *, coalesce(sum(source_size * 2) over before_, 0) as caps, coalesce(sum(weight) over before_, 0) as used,
  sum(weight) over () as w, sum(source_size) over () as total from w
  window before_ as (order by source_size * 2 / weight, rank rows between unbounded preceding and 1 preceding)),
t as (select *, least(weight * max((total * 1.5::double - caps) / (w - used)) over (), cast(source_size * 2 as double)) as target from v),
q as (select sk, source_size, target, ceil(n / 256) as blocks, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as passes from t),
r as (select z.*, source_size, target, passes, target - passes * source_size as rest, cast('0x' || h[1:8] as bigint) % cast(blocks as bigint) as block from z join q using (sk)),
e as (select *, row_number() over (partition by sk order by md5('9b|' || sk || '|' || block), block, h) as i from r where size > 0),
walk as (select sk, 0::bigint as i, rest as lft, null::varchar as h, false as more from (select distinct sk, rest from r)
  union all select e.sk, e.i, case when e.size <= walk.lft then walk.lft - e.size else walk.lft end, e.h, e.size <= walk.lft from walk join e on e.sk = walk.sk and e.i = walk.i + 1),
f as (select r.*, coalesce(walk.more, false) as more from r left join walk using (sk, h)),
bl as (select sk, block, any_value(passes) as passes, sum(case when more then size else 0 end) as quota from f group by sk, block),
u0 as (select sk, block, 0 as node, unnest(range(0, passes + case when quota > 0 then 1 else 0 end)) as pass from bl),""" + _OP9_LEVELS + r"""
de as (select sk, block, list(node order by pass) as dealt from u3 group by sk, block),
o as (select f.*, dealt, passes + case when more then 1 else 0 end as copies from f left join de using (sk, block))
select doc_id, size, source_size, target, cast(copies * size as bigint) as taken, h as row_hash,
  list_transform(coalesce(dealt, [])[1:copies], lambda x: cast(x as int)) as shards from o""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of each document, and the shards of its copies."""
    return mixing.plan(_table(spark, sf_dir, "documents"))


TOKENIZERS = "/opt/tokenizers"


@_query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """Piece ids of all documents, and whether they read back as the text."""
    vocabulary = pieces.load(spark, model)
    ids = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, round_trip="round_trip")
    return ids.select("doc_id", "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "round_trip")


@_query("op1_warc", r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest,
  max(page_id) over (partition by html) as best from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and best <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and best <> page_id then best end as refers_to from d""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back through their index."""
    records = warc.written_and_read(_table(spark, sf_dir, "pages"))
    return records.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                          "record_type", warc.page_of("refers_to").alias("refers_to"))


@_query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a three-gram model of those that are not held out."""
    return lm.score(_table(spark, sf_dir, "documents"), lm.held_out(F.col("doc_id")))


@_query("op2_embedding_neardup", r"""
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as x, vec_id as root from embeddings union select l.y, r.root from r join l on l.x = r.x),
c as (select x, min(root) as component_id from r group by x), n as (select x, count(*) as n from l group by x)
select vec_id, coalesce(n.n, 0) as n_links, component_id, component_id = vec_id as kept
from embeddings e join c on c.x = e.vec_id left join n on n.x = e.vec_id""")
def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of embeddings with a cosine of 0.9 or more."""
    found = vectors.near_classes(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@_query("op3_licences", licences.twin())
def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of all documents."""
    return licences.scan(_table(spark, sf_dir, "documents"))


@_query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """Greedy word-piece counts of all documents."""
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), vocabulary)


@_query("op11_hard_negatives", r"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh row carries the next label."""
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, label=moved)


@_query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; parts 0 and 1 of the keys are counted, part 3 calibrates, part 2 is held out."""
    part = languages.part_of(F.col("doc_id"))
    found = languages.identify(_table(spark, sf_dir, "documents"), part.isin(0, 1), part == 3)
    return found.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score", "bits_per_char", "accepted")


@_query("op13_infill", r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
l as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
  cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (select *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from l),
p as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:len(u)], '') as s from c)
select doc_id, cast(len(u) as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256 from p""")
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut for fill-in-middle training, with digests of the outputs and of the texts read back from them."""
    frames = infill.framed(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = infill.digests(infill.transform(frames))
    return done.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
