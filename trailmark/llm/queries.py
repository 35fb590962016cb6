"""The registered queries of the training-data operators over the provided tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontamination, divergence, exact_dedup, html_text, jaccard, kneser_ney, mixing, periodic, sharding, spelling, substring_dedup, suffix_dedup, typos, warc
from trailmark.llm.common import table, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


@query(
    """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
 p as (select doc_id, n, j, substr(h, 400 * j + 1, 498) as h from (select doc_id, h, n, unnest(range((n + 199) // 200)) as j from d)),
 b as (select doc_id, n, 200 * j + r as i, h, r from (select *, unnest(range(least(200, n - 200 * j))) as r from p)),
 w as (select doc_id, i, md5(substr(h, 2 * r + 1, 100)) as k from b where i <= n - 50),
 f as (select k, min(doc_id) as first_id from w group by k),
 hit as (select doc_id, i, true as hit from w join f using (k) where first_id < doc_id),
 c as (select doc_id, i, substr(h, 2 * r + 1, 2) as c, coalesce(bool_or(hit) over (partition by doc_id order by i rows between 49 preceding and current row), false) as gone from b left join hit using (doc_id, i)),
 s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from c),
 a as (select doc_id, count_if(gone) as n_removed, count_if(opens) as n_spans, string_agg(c, '' order by i) filter (where not gone) as kept from s group by doc_id)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join a using (doc_id)
"""
)
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


@query()
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query()
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query()
def op4_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    """
with t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws from documents),
 s as (select doc_id, list_distinct(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from t),
 e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
 often as (select *, count(*) over (partition by g) as df from e),
 placed as (select doc_id, n, g, df, row_number() over (partition by doc_id order by df, g) as k from often),
 head as (select * from placed where k <= n - cast(ceil(n * 9 / 10.0) as bigint) + 1 and df > 1),
 pair as (select distinct a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny from head a join head b on a.g = b.g and a.doc_id < b.doc_id and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
 met as (select x, y, nx, ny, count(*) as shared from pair join e a on a.doc_id = x join e b on b.doc_id = y and b.g = a.g group by all),
 link as (select x, y from met where 100 * shared >= 90 * (nx + ny - shared)),
 both_ways as (select x, y from link union select y, x from link),
 reached as (with recursive r(doc_id, seen) as (select doc_id, doc_id from documents union select r.doc_id, b.y from r join both_ways b on b.x = r.seen) select doc_id, min(seen) as component_id from r group by doc_id)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, component_id from s join reached using (doc_id)
"""
)
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), words=3, enough=(9, 10))


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), stored=True)


@query(
    """
with item as (select item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws from benchmark),
 item_word as (select item_id, unnest(ws) as w, unnest(range(len(ws))) as i from item where len(ws) >= 13),
 short as (select item_id, ws, ws[1] as w from item where len(ws) between 3 and 12),
 doc as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws from documents),
 doc_word as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as p from doc),
 hit as (select doc_id, item_id, p - i as diagonal, i from doc_word join item_word using (w)),
 run as (select doc_id, item_id, count(*) over (partition by doc_id, item_id, diagonal order by i range between 12 preceding and current row) as n from hit),
 whole as (select d.doc_id, item_id from doc_word d join short using (w) join doc on doc.doc_id = d.doc_id where doc.ws[p + 1:p + len(short.ws)] = short.ws),
 found as (select doc_id, count(distinct item_id) as n_items from (select doc_id, item_id from run where n >= 11 union select doc_id, item_id from whole) group by doc_id)
select d.doc_id, coalesce(n_items, 0) > 0 as contaminated, coalesce(n_items, 0) as n_items from documents d left join found using (doc_id)
"""
)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole_from=3)


@query(
    """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws from documents),
 w as (select doc_id, i, md5(array_to_string(ws[i + 1:i + 20], ' ')) as k from (select doc_id, ws, unnest(range(greatest(len(ws) - 19, 0))) as i from d)),
 hit as (select doc_id, i, row_number() over (partition by k order by doc_id, i) > 1 as hit from w),
 b as (select doc_id, unnest(range(len(ws))) as i, unnest(ws) as c from d),
 c as (select doc_id, i, c, coalesce(bool_or(hit) over (partition by doc_id order by i rows between 19 preceding and current row), false) as gone from b left join hit using (doc_id, i)),
 a as (select doc_id, count_if(gone) as n_removed, string_agg(c, ' ' order by i) filter (where not gone) as kept from c group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join a using (doc_id)
"""
)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


@query(
    """
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256 from documents),
 g as (select *, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size from t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g
"""
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    """
with p as (select page_id, sha1(coalesce(html, '')) as x, strlen(coalesce(html, '')) as payload_bytes from pages),
 d as (select *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  cast(((((instr('0123456789abcdef', substr(x, cast(5 * i // 4 + 1 as int), 1)) - 1) * 16
   + greatest(instr('0123456789abcdef', substr(x, cast(5 * i // 4 + 2 as int), 1)) - 1, 0)) >> cast(3 - (5 * i) % 4 as int)) & 31) + 1 as int), 1)), 'string_agg', '') as payload_digest from p),
 f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first_id from d)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
 case when page_id <> first_id then first_id end as refers_to from f
"""
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def crc32_sql(hexed: str, table_of: str = "t") -> str:
    """SQL for the unsigned crc32 of a text given as hex digits; the column ``table_of`` holds ``CRC_TABLE``."""
    octets = f"list_transform(range(length({hexed}) // 2), lambda k: cast('0x' || substr({hexed}, cast(2 * k + 1 as int), 2) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor({table_of}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of all documents, where one in ten goes on with a period of its own from some word on."""
    numbered = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    cut = numbered.withColumn("ws", F.when(F.col("h") % 10 == 0, words("text"))).withColumn("n", F.size("ws").cast("long"))
    placed = cut.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    sized = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    word = F.transform("ws", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("ws", F.expr("cast(a as int)") + (i - F.col("a").cast("int")) % F.col("p").cast("int"))))
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


PERIODS = 12  # doublings above 16 words, so the SQL finds periods up to 65,536 words
HASH_LEVELS = ",\n ".join(
    f"h{k + 1} as (select doc_id, n, i, case when i + {2 << k} <= n then hash(g, lead(g, {1 << k}) over (partition by doc_id order by i)) end as g from h{k})" for k in range(PERIODS + 4)
)
NEXT_COPIES = " union all ".join(
    f"select doc_id, i, {1 << k} as g, lead(i) over (partition by doc_id, g order by i) - i as q from h{k} where g is not null" for k in range(4, PERIODS + 5)
)


@query(
    f"""
with k as materialized (select {CRC_TABLE} as t),
 d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws, hex(encode(cast(doc_id as varchar))) as x from documents),
 c as (select doc_id, ws, len(ws) as n, {crc32_sql("x")} as h from d, k),
 a as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, h // 10 as g from c),
 w as (select doc_id, n, i, case when i >= a then ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] else ws[i + 1] end as c from (select *, unnest(range(n)) as i from a)),
 h0 as materialized (select doc_id, n, i, hash(c) as g from w),
 {HASH_LEVELS},
 m as (select * from ({NEXT_COPIES}) where q <= g and (q > g // 2 or g = 16)),
 s as (select doc_id, g, q, i, i - row_number() over (partition by doc_id, g, q order by i) as island from m),
 r as materialized (select doc_id, min(i) as start, max(i) + g + q - min(i) as length, q as period from s group by doc_id, g, q, island having max(i) + g + q - min(i) >= greatest(24, 3 * q)),
 gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
 kept as (select doc_id, string_agg(c, ' ' order by i) as collapsed from w anti join gone using (doc_id, i) group by doc_id),
 top as (select *, count(*) over (partition by doc_id) as n_runs from r qualify row_number() over (partition by doc_id order by length / period desc, start, period) = 1),
 sums as (select doc_id, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as listed from r group by doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
 sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from documents left join top using (doc_id) left join sums using (doc_id) left join kept using (doc_id)
"""
)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapsed_runs(with_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = found.withColumn("top", periodic.most_periods("runs"))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(
    f"""
with recursive k as materialized (select {CRC_TABLE} as t),
 d as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) as w from documents),
 c as (select id, w, count(*) as n, hex(encode(concat(id, ':', w))) as x from d where length(w) >= 5 group by id, w),
 h as (select w, n, {crc32_sql("x")} as h from c, k),
 e as (select case when h % 97 = 0 then concat(substr(w, 1, cast(h % length(w) as int)), substr(w, cast(h % length(w) + 2 as int))) else w end as word, n from h),
 v as materialized (select word, cast(sum(n) as bigint) as n from e where length(word) >= 5 group by word having sum(n) >= 3),
 cut as materialized (select word, i, concat(substr(word, 1, i), substr(word, i + 2)) as rest from (select word, cast(unnest(range(length(word))) as int) as i from v)),
 pair as materialized (
  select a.word, b.word as other from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select cut.word, v.word from cut join v on rest = v.word
  union select v.word, cut.word from cut join v on rest = v.word),
 best as (select p.word, o.word as form, o.n as form_n, count(*) over (partition by p.word) as n_near from pair p join v o on o.word = p.other
  qualify row_number() over (partition by p.word order by o.n desc, o.word) = 1),
 form as materialized (select v.word, n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * n then form end as form, case when form_n >= 2 * n then form_n end as form_n from v left join best using (word)),
 chain as (select word, form as root, 1 as step from form where form is not null
  union all select chain.word, form.form, step + 1 from chain join form on form.word = chain.root where form.form is not null),
 root as (select word, arg_max(root, step) as root from chain group by word)
select word, form, coalesce(root, word) as root, n, n_near, form_n from form left join root using (word)
"""
)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), edit=typos.drop_letters)


@query(
    r"""
with d as (select doc_id, lang, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
 w as materialized (select doc_id, lang, unnest(ws) as w, unnest(range(len(ws))) as i from d),
 g as (select doc_id, i, concat(w, ' ', lead(w) over p, ' ', lead(w, 2) over p) as g, lead(w, 2) over p as third from w window p as (partition by doc_id order by i)),
 twice as (select doc_id, i, count(*) over (partition by doc_id, g) > 1 as hit from g where third is not null),
 rep as (select doc_id, count(distinct i + k) as n_repeat_words from twice, (select unnest([0, 1, 2]) as k) where hit group by doc_id),
 lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
 dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
 base as materialized (select doc_id, lang, text, cast(len(ws) as bigint) as n_words, cast(length(text) as bigint) as n_chars, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
   cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join dup using (doc_id) left join rep using (doc_id)),
 class as materialized (select doc_id, lang, n_chars, unnest(range(8)) as k, unnest([length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')),
   length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^.,;:!?''"()-]', '', 'g')), length(regexp_replace(text, '[\x20\x09-\x0DA-Za-z0-9.,;:!?''"()-]|[^\x00-\x7F]', '', 'g')),
   length(regexp_replace(text, '[^\x{80}-\x{7FF}]', '', 'g')), length(regexp_replace(text, '[\x00-\x{7FF}]', '', 'g'))]) as n from base),
 ids as (select doc_id, lang from (select distinct doc_id, lang from documents where lang is not null) semi join (from labels where quality = 1 and toxic = 0) using (doc_id)
  qualify row_number() over (partition by lang order by md5(cast(doc_id as varchar))) <= 2000),
 sample as materialized (select doc_id, lang from ids where lang in (select lang from ids group by lang having count(*) >= 50)),
 word as (select lang, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as word, count(*) as n from w semi join sample using (doc_id) group by all),
 common as (select lang, word, n / sum(n) over (partition by lang) as q from word qualify row_number() over (partition by lang order by n desc, word) <= 100),
 met as (select doc_id, word, count(*) as n from (select doc_id, lang, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as word from w) join common using (lang, word) group by all),
 bins as (select doc_id, n_words, word, coalesce(n, 0) / n_words as p, q from base join common using (lang) left join met using (doc_id, word) where n_words >= 100),
 word_bins as (select doc_id, p, q from bins union all select doc_id, 1 - sum(p), 1 - sum(q) from bins group by doc_id),
 refs as (select lang, k, sum(n) / sum(n_chars) as q from class semi join sample using (doc_id) group by lang, k),
 char_bins as (select doc_id, n / n_chars as p, q from class join refs using (lang, k) where n_chars >= 200),
 both_bins as (select doc_id, 'c' as kind, p, q from char_bins union all select doc_id, 'w', greatest(p, 0), greatest(q, 0) from word_bins),
 js as (select doc_id, kind, cast(round(10000 * sqrt(greatest(sum(case when p > 1e-12 then p * log2(2 * p / (p + q)) else 0 end + case when q > 1e-12 then q * log2(2 * q / (p + q)) else 0 end) / 2, 0))) as bigint) as v from both_bins group by doc_id, kind),
 dist as materialized (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, cast(floor(log2(greatest(n_words, 1))) as int) as power from base left join (select doc_id, v as char_distance from js where kind = 'c') using (doc_id) left join (select doc_id, v as word_distance from js where kind = 'w') using (doc_id)),
 held as (select lang, unnest([power, -1]) as power, char_distance as c, word_distance as w from dist semi join sample using (doc_id) where not base_failed),
 lim as (select lang, power, floor(coalesce(quantile_disc(c, 0.99) * 1.1::double, 10000)) as char_limit, floor(coalesce(quantile_disc(w, 0.99) * 1.1::double, 10000)) as word_limit from held group by lang, power having count(*) >= 100 or power = -1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
 not base_failed and coalesce(char_distance <= coalesce(a.char_limit, b.char_limit), true) and coalesce(word_distance <= coalesce(a.word_limit, b.word_limit), true) as kept
from dist left join lim a on a.lang = dist.lang and a.power = dist.power left join lim b on b.lang = dist.lang and b.power = -1
"""
)
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.drop("lang")
