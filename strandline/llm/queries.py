"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chat, embed_dedup, html_extract, langid, licences, line_dedup, mixing, packing, prefix_trie, quality, resample, simhash, token_files
from strandline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, oracle: str | None = None):
    """Register ``fn(*tables as frames) -> DataFrame``."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(*(tune(spark).read.parquet(f"{folder.rstrip('/')}/{t}.parquet") for t in tables))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_main_text", "pages")
def op1_main_text(pages):
    return html_extract.extract(pages)


@query("op2_pack_documents", "documents")
def op2_pack_documents(documents):
    return packing.pack_documents(documents, vocabulary("word_bpe_49k.json"))


@query(
    "op3_mix_sources",
    "documents",
    oracle=r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size,
    md5(coalesce(cast(doc_id as varchar), '')||':0') k from documents
), totals as (
  select source, cast(sum(size) as bigint) source_size,
    [3.0e0, 1.0e0, 2.0e0][cast((row_number() over (order by source is null, encode(source)) - 1) % 3 as int) + 1] w
  from sized group by source
), filled as (
  select *, cast(sum(2 * source_size) over a as double) - 2 * source_size full_before, sum(w) over () - sum(w) over a + w open_weight,
    1.5e0 * cast(sum(source_size) over () as double) wanted
  from totals window a as (order by 2 * source_size / w, source is null, encode(source) rows unbounded preceding)
), level as (
  select coalesce(max(case when 2 * source_size / w >= (wanted - full_before) / open_weight then (wanted - full_before) / open_weight end), 0) lvl
  from filled
), targets as (
  select source, source_size, least(cast(2 * source_size as double), w * lvl) target from totals, level
), placed as (
  select s.doc_id, s.size, t.source_size, t.target, cast(floor(t.target + 0.5) as bigint) quota,
    cast(sum(size) over (partition by s.source order by k, doc_id, size rows unbounded preceding) as bigint) - size before
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast(case when source_size = 0 then 0 else (quota // source_size) * size
    + greatest(0, least(size, quota - (quota // source_size) * source_size - before)) end as bigint) taken
from placed
""",
)
def op3_mix_sources(documents):
    return mixing.mix(documents)


@query("op4_language_id", "documents")
def op4_language_id(documents):
    return langid.predict(documents).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


@query("op5_simhash_groups", "documents")
def op5_simhash_groups(documents):
    hex_digits = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return simhash.near_groups(documents).select("doc_id", hex_digits, "component_id")


@query("op6_licence_scan", "documents")
def op6_licence_scan(documents):
    found = licences.scan(documents)
    return found.select("doc_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("licences", "rules", "sentences")])


@query("op7_embedding_groups", "embeddings")
def op7_embedding_groups(embeddings):
    return embed_dedup.near_vectors(embeddings)


@query("op8_quality_rules", "documents", "labels")
def op8_quality_rules(documents, labels):
    judged = quality.judge(documents, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(
    "op9_line_dedup",
    "documents",
    oracle=r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos
  from documents
), keyed as (
  select doc_id, pos, line, translate(trim(line, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines
), frequent as (
  select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10
)
select doc_id, cast(count(*) as bigint) n_lines, cast(count(f.k) as bigint) n_dropped,
  sha256(coalesce(string_agg(case when f.k is null then line end, chr(10) order by pos), '')) kept_sha256
from keyed left join frequent f on keyed.k = f.k group by doc_id
""",
)
def op9_line_dedup(documents):
    kept = line_dedup.drop_repeated_lines(documents, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op10_token_files", "documents")
def op10_token_files(documents):
    return token_files.write_and_read(documents, vocabulary("byte_bpe_50k.json"))


# CRC-32 of a string in SQL: its UTF-8 bytes in turn, by the table of the polynomial (joined in as ``crc_table``).
_CRC_TABLE = """crc_table as (
  select list(c order by i) t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) c
  from (select unnest(range(256)) i)))"""


def _crc(text: str) -> str:
    byte = f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * k + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * k + 2, 1)) - 1"
    each = f"list_transform(range(octet_length(encode({text}))), lambda k: cast({byte} as bigint))"
    steps = f"list_reduce(list_prepend(cast(4294967295 as bigint), {each}), lambda c, b: xor(c >> 8, crc_table.t[xor(c & 255, b) + 1]))"
    return f"xor({steps}, 4294967295)"


@query(
    "op12_importance_resampling",
    "documents",
    "benchmark",
    oracle=rf"""
with {_CRC_TABLE}, texts as (
  select 'd' kind, row_number() over () id, doc_id, text from documents union all select 'b', row_number() over (), null, text from benchmark
), split as (
  select kind, id, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from texts
), features as (
  select kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f from split
), distinct_features as (
  select f, {_crc("f")} % 10000 bucket from (select distinct f from features), crc_table
), bucketed as (select kind, id, bucket from features join distinct_features using (f)
), counts as (
  select bucket, cast(count(*) filter (kind = 'd') as double) s, cast(count(*) filter (kind = 'b') as double) t from bucketed group by bucket
), gains as (
  select bucket, cast(floor(1000 * ln(((t + 1) * (sum(s) over () + 10000)) / ((s + 1) * (sum(t) over () + 10000)))) as bigint) gain from counts
), weighed as (
  select id, count(*) n_features, cast(sum(gain) as bigint) summed from bucketed join gains using (bucket) where kind = 'd' group by id
), scored as (
  select doc_id, coalesce(n_features, 0) n_features, len(w) n_words,
    cast(coalesce((summed - ((summed % n_features) + n_features) % n_features) // n_features, 0) as bigint) weight,
    cast(('0x' || substr(sha256('7:' || doc_id), 1, 8)) as bigint) h
  from split left join weighed using (id) where kind = 'd'
), full_scores as (
  select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) as bigint) score from scored
), ranked as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) r, 25 * count(*) filter (n_words >= 20) over () // 100 n_drawn from full_scores
)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= n_drawn then r end "rank" from ranked
""",
)
def op12_importance_resampling(documents, benchmark):
    return resample.resample(documents, benchmark, percent=25, min_words=20, seed=7)


def _escaped(text: str) -> str:
    return f"regexp_replace({text}, '([<\\[])(\\\\*)(/INST\\]|/s>|INST\\]|s>|\\|endoftext\\|>)', '\\1\\\\\\2\\3', 'g')"


@query(
    "op13_chat_format",
    "conversations",
    oracle=rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), joined as (
  select conv_id, count(*) n_turns, string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first) whole,
    coalesce(string_agg(case when r = 'assistant' then x end, '' order by turn nulls first), '') loss,
    sum(length('<s>[INST]' || {_escaped("r")} || '[/INST]' || {_escaped("x")} || '</s>')) formatted
  from turns group by conv_id
)
select conv_id, n_turns, sha256(whole) turns_sha256, cast(length(loss) as bigint) loss_chars, sha256(loss) loss_sha256, cast(formatted as bigint) formatted_chars
from joined
""",
)
def op13_chat_format(conversations):
    rows = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    own = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    return chat.format_and_read(conversations.select(*columns).unionByName(own), vocabulary("byte_bpe_50k.json"))


@query(
    "op11_prefix_trie",
    "conversations",
    oracle=rf"""
with {_CRC_TABLE}, own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 p, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) x,
    length(coalesce(text, '')) l from conversations where conv_id is not null
), cut as (
  select conv_id, conv_id - conv_id % 100 family, {_crc("cast(conv_id as varchar)")} % 6 h from (select distinct conv_id from own), crc_table
), turns as (
  select c.conv_id, 0 seg, p, x, l from cut c join own o on o.conv_id = c.family and p < h union all select conv_id, 1, p, x, l from cut join own using (conv_id) where p >= h
), sequences as (
  select c.conv_id, coalesce(list(x order by seg, p) filter (x is not null), []) s, list(l order by seg, p) ls from cut c left join turns using (conv_id) group by c.conv_id
), places as (
  select conv_id, d, len(s) n, md5(array_to_string(s[:d], '')) k, case when d > 0 then md5(array_to_string(s[:d - 1], '')) end up, case when d > 0 then ls[d] else 0 end l
  from (select *, unnest(range(len(s) + 1)) d from sequences)
), nodes as (
  select k, d, any_value(up) up, any_value(l) l, min(conv_id) conv_id, count(*) n_convs,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (d = n), '')) ends_sha256 from places group by k, d
), children as (select up k, count(*) c from nodes where d > 0 group by up), sums as (
  select a.k, count(*) filter (c.c is null) leaves, sum((n.n_convs - 1) * n.l) saved
  from nodes n left join children c using (k) join places a on a.conv_id = n.conv_id and a.d <= n.d group by a.k
)
select n.conv_id, n.d depth, u.conv_id parent_conv_id, n.n_convs, coalesce(c.c, 0) n_children, leaves n_leaves, cast(saved as bigint) saved_tokens, n.ends_sha256
from nodes n left join children c using (k) join sums s on s.k = n.k left join nodes u on u.k = n.up
""",
)
def op11_prefix_trie(conversations):
    return prefix_trie.prefix_trie(conversations)
