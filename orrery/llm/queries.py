"""The registered queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, language_id, mixing, ngram_join, prefix_trie, quality, secret_scan, sharding, simhash, token_counts, url_filter, warc
from ._common import cut, read, shared_path

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 24


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).counts()


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    where = shared_path(spark, "warc")
    store, top = warc.open_folder(where)
    try:
        index = warc.CaptureIndex.build(warc.write_archives(pages, where), where)
        found = index.locate(pages.select(warc.sort_key(F.col("url"), F.col("page_id")).alias("k")))
        got = warc.fetch(found, where, payload=False)
        return cut(got.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:  # the digest is kept, the archives were written for it alone
        store.create_dir(top)  # an empty table has written nothing
        store.delete_dir(top)


def op4_token_counts(spark: SparkSession, sf_dir: str, model: str = token_counts.MODEL) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), token_counts.Vocabulary.load(model))


def spans_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    kind = lambda k: F.filter("findings", lambda x: x["kind"] == k)
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        key,
        *[F.size(kind(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.filter("findings", lambda x: x["kind"] != "model")), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_digest(secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: The list has the canonical url (host and path) of each page that holds this mark of junk.
JUNK = "***"
#: Sites whose pages are blocked where no rule says otherwise.
SITES = [
    ("ads-track.example.org", "/"),
    ("adult-x.example.net", "/"),
    ("casino-win.example.org", "/"),
    ("cheap-pills.example.com", "/"),
    ("free-bets.example.com", "/"),
    ("spam-farm.example.org", "/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"select * from values {', '.join(map(str, RULES))} as t(host, path, verdict)")
    pages = read(spark, sf_dir, "pages")
    host, path = url_filter.host_and_path(F.col("url"))
    junk = pages.where(F.contains("html", F.lit(JUNK))).select(host.alias("host"), path.alias("path")).distinct()
    sites = spark.sql(f"select * from values {', '.join(map(str, SITES))} as t(host, path)")
    return url_filter.judge_urls(pages, rules, sites, junk)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all evidence; documents by text and source (as host). Either id is null in the other's rows. The models
    learn from documents' ``lang``, which is therefore no evidence of a document's own language here."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = docs.select("doc_id", none.alias("page_id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"), F.lit(False).alias("markup")).unionByName(
        pages.select(
            none.alias("doc_id"), "page_id", F.col("html").alias("text"), language_id.declared_in(F.col("html")).alias("declared"), language_id.host_of(F.col("url")).alias("host"),
            F.lit(True).alias("markup"),
        )
    )
    return language_id.identify(rows, language_id.fit(docs), ["doc_id", "page_id"], F.col("markup"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < quality.MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return quality.judge(docs).select(
        "doc_id", *quality.MEASURES, failed.alias("base_failed"), (~failed & F.col("first_failed").isNull()).alias("kept")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    dealt = sharding.number_slots(sharding.assign_shards(rows, "doc_id", SHARDS), ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    turns = prefix_trie.encoded(read(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(read(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_decontaminate": op10_decontaminate,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ngram_join": op12_ngram_join,
    "op13_centroids": op13_centroids,
}



def clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Every distance of every round, by joins of components."""
    distances = """
d{r} as (
    select v.r, c.j, cast(sum((v.x - c.x) * (v.x - c.x)) as bigint) as d from x as v join c{r} as c using (i) group by v.r, c.j
), n{r} as (
    select r, j, d from d{r} qualify row_number() over (partition by r order by d, j) = 1
)"""
    means = """
c{s} as (
    select c.j, c.i, coalesce(m.x, c.x) as x from c{r} as c left join (
        select n.j, v.i, cast(floor(sum(v.x)::decimal(38,0) / count(*)) as bigint) as x from n{r} as n join x as v using (r) group by n.j, v.i
    ) as m using (j, i)
)"""
    steps = ",".join(distances.format(r=r) + "," + means.format(r=r, s=r + 1) for r in range(rounds)) + "," + distances.format(r=rounds)
    return f"""
with e as (
    select row_number() over () as r, vec_id, embedding from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = 64
), x as materialized (
    select r, unnest(range(64)) as i, unnest(list_transform(embedding, lambda v: cast(floor(64 * v::double) as bigint))) as x from e
), c0 as (
    select j, i, x from x join (select r, row_number() over (order by sha256('1:' || vec_id)) - 1 as j from e) using (r) where j < {k}
),{steps}
select vec_id, cast(j as integer) as cluster, d as distance, cast(sum(d) over (partition by j) as bigint) as cluster_inertia,
    cast(sum(d) over () as bigint) as inertia, sha as centroid_sha256
from n{rounds} join e using (r) join (select j, sha256(string_agg(cast(x as varchar), ',' order by i)) as sha from c{rounds} group by j) using (j)
"""


#: Words of a text in DuckDB: the runs that are not ASCII blanks.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LIST = ", ".join([*(f"('{h}', '{p}', '{v}')" for h, p, v in RULES), *(f"('{h}', '{p}', null)" for h, p in SITES)])

ORACLES: dict[str, str] = {
    "op3_warc": """
with p as (
    select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as payload_digest,
        cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages
), g as (
    select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as keeper from p
)
select page_id, payload_bytes, payload_digest,
    case when keeper is not null and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
    case when page_id is distinct from keeper then keeper end as refers_to
from g
""",
    "op6_url_filter": f"""
with named(lhost, lpath, verdict) as (values {_LIST}),
u as (select row_number() over () as r, page_id, contains(html, '{JUNK}') as junk, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (
    select r, page_id, junk, regexp_extract(rest, '^([^/?#]*)', 1) as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
        translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from u
), fits as (
    select r, lhost || lpath as key, verdict from p join named
    on (host = lhost or ends_with(host, '.' || lhost)) and starts_with(path, lpath)
    union all select r, null, null from p semi join (select host, path from p where junk and host <> '') using (host, path)
), best as (
    select r, arg_max(key, len(key)) filter (verdict is not null) as rule,
        arg_max(verdict, len(key)) filter (verdict is not null) as verdict from fits group by r
)
select page_id, host, path, rule, coalesce(best.verdict, case when best.r is not null then 'block' end, 'allow') as verdict
from p left join best using (r)
""",
    "op11_prefix_trie": """
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations where conv_id is not null
), i as (
    select *, dense_rank() over (order by role, txt) as id, octet_length(encode(txt)) as bytes from t
), own as (
    select conv_id, list(id order by turn nulls first, role, txt) as ids, list(bytes order by turn nulls first, role, txt) as bs from i group by conv_id
), crc as (  -- of each byte: xor it in, then eight shifts (marked -1)
    select conv_id, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast(conv_id as varchar), ''),
        lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) % 9 as h from own
), seq as (
    select o.conv_id, list_concat(coalesce(b.ids[1:h], []), o.ids[h + 1:]) as ids, list_concat(coalesce(b.bs[1:h], []), o.bs[h + 1:]) as bs
    from own as o join crc using (conv_id) left join own as b on b.conv_id = o.conv_id - o.conv_id % 5
), p as materialized (
    select conv_id, d, ids[1:d] as key, case when d = 0 then 0 else bs[d] end as bytes, len(ids) = d as over
    from (select *, unnest(range(len(ids) + 1)) as d from seq)
), n as materialized (
    select d, key, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (over), '')) as ends_sha256
    from p group by d, key
), kids as (select d - 1 as d, key[1:d - 1] as key, count(*) as n_children from n where d > 0 group by all
), m as (
    select n.*, coalesce(n_children, 0) as n_children from n left join kids using (d, key)
), sums as (
    select p.d, p.key, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * m.bytes) as saved_tokens
    from m join p on p.conv_id = m.conv_id and p.d <= m.d group by p.d, p.key
)
select m.conv_id, m.d as depth, up.conv_id as parent_conv_id, m.n_convs, m.n_children, cast(n_leaves as bigint) as n_leaves,
    cast(saved_tokens as bigint) as saved_tokens, m.ends_sha256
from m join sums using (d, key) left join n as up on up.d = m.d - 1 and up.key = m.key[1:m.d - 1]
""",
    "op12_ngram_join": rf"""
with recursive d as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w
    from documents
), s as materialized (
    select distinct r, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] end) as g from d
), n as (select r, count(*) as n from s group by r
), met as (select a.r as x, b.r as y, count(*) as i from s as a join s as b using (g) where a.r <> b.r group by x, y
), links as materialized (
    select x, y from met join n as a on a.r = x join n as b on b.r = y where 100 * i >= 80 * (a.n + b.n - i)
), reach as (
    select r, r as m from d union select reach.r, y as m from reach join links on x = m
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, coalesce(n_links, 0) as n_links
from d join (select reach.r, min(t.doc_id) as component_id from reach join d as t on t.r = m group by reach.r) as c using (r)
left join n using (r) left join (select x as r, count(*) as n_links from links group by x) as l using (r)
""",
    "op13_centroids": clusters_sql(),
    "op8_quality_rules": rf"""
with d as (
    select row_number() over () as r, doc_id, coalesce(text, '') as t, {_WORDS} as w from documents
), windows as (
    select r, i, array_to_string(w[i:i + 7], ' ') as g
    from (select r, w, unnest(range(1, len(w) - 6)) as i from d)
), twice as (
    select r, i from (select r, i, count(*) over (partition by r, g) as n from windows) where n > 1
), covered as (
    select r, count(distinct i + k) as n from twice, range(8) as ks(k) group by r
), lines as (
    select r, unnest(string_split(t, chr(10))) as line from d
), dups as (
    select r, count(*) as n_lines, count(*) - count(distinct line) as n
    from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by r
), m as (
    select doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars,
        len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(dups.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
        len(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as up, len(regexp_replace(t, '[^\p{{Ll}}]', '', 'g')) as low
    from d left join dups using (r) left join covered using (r)
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
    cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
    cast(n_repeat_words as bigint) as n_repeat_words,
    n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 100 * n_symbols > 30 * n_words
        or 100 * n_dup_lines > 50 * n_lines or not word_chars between 2 * n_words and 40 * n_words
        or up > low) as kept
from m
""",
}
