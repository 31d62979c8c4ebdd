"""Contract queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import decontaminate, jaccard_join, license_scan, merkle, packing, prefix_trie, private_spans, quality, sharding, token_output, toxicity, url_filters, warc
from vitalgrid.llm.common import LOWER, UPPER, table

#: Fixed values of the contract.
URL_RULES = [
    url_filters.UrlRule("net/", "block"),
    url_filters.UrlRule("example.net/en/", "allow"),
    url_filters.UrlRule("example.com/de/", "block"),
    url_filters.UrlRule("org/fr/", "allow"),
]
N_SHARDS = 40
PACKED_IDS = "<u2"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = f"""
with parts as (
  select page_id, row_number() over () as n,
         coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end, '') as rest
  from pages
), judged as (
  select page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(rule, rule_host, rule_path, action) as (
  values {", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.action}')" for r in URL_RULES)}
), fits as (
  select n, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
  from judged, rules
  where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by n
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict
from judged left join fits using (n)
"""


def packed_documents(docs: DataFrame) -> DataFrame:
    """Every piece as it stands in the written sequences."""
    pieces = packing.token_pieces(docs, vocabulary("word_bpe_49k.json"), with_ids=True, id_type=PACKED_IDS)
    return packing.read_pieces(packing.write_sequences(packing.pack(pieces)), PACKED_IDS)


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")
    )
    placed = sharding.hilbert_shards(docs, ["lang", "source", "n_chars"], N_SHARDS, "rows", tie_cols=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "lang", "source", "n_chars")


def op4_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_ids(token_output.write_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op5_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "item_words", "covered_words", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables have no capture times: one second a page from 2000 on
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", (F.col("page_id") + 946684800).alias("seconds"))
    captures = warc.index_archives(warc.write_archives(pages))
    return captures.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP6_SQL = f"""
with payloads as (
  select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages
), bits as (
  select *, array_to_string(list_transform(string_split(sha, ''), lambda h: lpad(bin(strpos('0123456789abcdef', h) - 1), 4, '0')), '') as b from payloads
), originals as (
  select sha, max(page_id) as first from payloads group by sha
), parts as (
  select *, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else url end as rest from bits
)
select page_id, octet_length(encode(html)) as payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('{_BASE32}', list_sum(list_transform(range(5), lambda j: substr(b, (k * 5 + j + 1)::int, 1)::int * (16 >> j::int)))::int + 1, 1)), '') as payload_digest,
       case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from first then first end as refers_to,
       case when coalesce(url, '') = '' then '' else lower(array_to_string(list_reverse(string_split(regexp_extract(rest, '^[^/?#]*'), '.')), ',') || ')' || coalesce(nullif(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), ''), '/')) end as url_key,
       strftime(to_timestamp(coalesce(page_id + 946684800, 0)) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as timestamp
from parts join originals using (sha)
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    return quality.apply_quality(docs, model).select("doc_id", *names)


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
with recursive words as (
  select doc_id, row_number() over () as n, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents
), shingles as (
  select n, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end) as s from words
), flat as (
  select n, len(s) as size, unnest(s) as x from shingles
), links as (
  select a.n as a, b.n as b from flat a join flat b on a.x = b.x and a.n < b.n
  group by a.n, b.n, a.size, b.size having 100 * count(*) >= 75 * (a.size + b.size - count(*))
), both_ways as (
  select a, b from links union all select b, a from links
), many as (
  select a as n, count(*) as n_links from both_ways group by a
), reach as (
  select n, n as m from shingles union select b, m from reach join both_ways on n = a
)
select s.doc_id, len(s.s) as n_shingles, min(t.doc_id) as component_id, coalesce(max(many.n_links), 0) as n_links
from shingles s join reach r on r.n = s.n join shingles t on t.n = r.m left join many on many.n = s.n
group by s.n, s.doc_id, len(s.s)
"""


def op10_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), where=fold != 1)
    scored = toxicity.apply_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted", "spans")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def _canonical_sql(c: str) -> str:
    marked = f"regexp_replace(regexp_replace(lower({c}), '{license_scan.COPYRIGHT_LINE}', '\\1', 'g'), '{license_scan.BLANKS}', ' ', 'g')"
    out = f"' ' || replace({marked}, chr(10), ' ') || ' '"
    for spelling, one in license_scan.SPELLINGS:
        out = f"replace({out}, ' {spelling} ', ' {one} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


OP8_SQL = f"""
with known(license_id, text) as (
  values {", ".join(f"('{k.license_id}', '{k.text}')" for k in license_scan.NOTICES)}
), digests as (
  select license_id, sha256({_canonical_sql("text")}) as digest from known
), units as (
  select doc_id, 'text' as unit, 0 as line_no, text as matched from documents where text is not null
  union all
  select doc_id, 'line', k, string_split(text, chr(10))[k]
  from (select doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10)))))::int as k from documents where text is not null)
), formed as (
  select *, {_canonical_sql("matched")} as form from units
)
select doc_id, license_id, unit, line_no, matched, digest
from (select *, sha256(form) as digest from formed where form <> '') join digests using (digest)
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    proofs = merkle.merkle_proofs(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id",
        changed={"n_chars": F.col("n_chars") + 1}, changed_where=F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
    )
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


_CRC_TABLE = """
crc_bits(n, c, k) as (
  select range::ubigint, range::ubigint, 0 from range(256)
  union all
  select n, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from crc_bits where k < 8
), crc_table as (
  select list(c order by n) as t from crc_bits where k = 8
)"""


def _crc_sql(number: str) -> str:
    """Unsigned crc32 of a number's decimal form; ``t`` of crc_table must be in scope."""
    digits = f"list_transform(string_split({number}::varchar, ''), lambda d: ascii(d)::ubigint)"
    step = "xor(t[(xor(acc, x) & 255)::int + 1], acc >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {digits}), lambda acc, x: {step}), 4294967295::ubigint)"


def _leaf_sql(n_chars: str) -> str:
    cells = [f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(cells)})"


def _levels_sql(name: str, tree: str, start: str) -> str:
    return f"""{name}(tree, level, pos, node, n) as (
  {start}
  union all
  select tree, level + 1, pos, node, count(*) over (partition by {tree}) from (
    select tree, level, pos // 2 as pos, sha256(string_agg(node, '' order by pos)) as node from {name} where n > 1 group by tree, level, pos // 2
  )
)"""


def _steps_sql(name: str, rows: str, key: str, tree: str) -> str:
    """Per row: its siblings in order, and what stands left and right of its path at each level."""
    return f"""select r.{key}, coalesce(string_agg(s.node, '' order by u.level), '') as proof,
         coalesce(list([case when (r.pos >> u.level) % 2 = 1 then s.node else '' end, case when (r.pos >> u.level) % 2 = 0 then coalesce(s.node, '') else '' end] order by u.level), []) as steps
  from {rows} r
  join {name} u on u.tree is not distinct from r.{tree} and u.pos = r.pos >> u.level and u.n > 1
  left join {name} s on s.tree is not distinct from u.tree and s.level = u.level and s.pos = xor(u.pos, 1)
  group by r.{key}"""


OP11_SQL = f"""
with recursive {_CRC_TABLE}, leaves as (
  select row_number() over () as r, doc_id, lang, {_leaf_sql("n_chars")} as leaf,
         case when {_crc_sql("doc_id")} % 7 = 0 then {_leaf_sql("(n_chars + 1)")} else {_leaf_sql("n_chars")} end as seen
  from documents, crc_table
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as pos from leaves
), {_levels_sql("inner_nodes", "tree", "select lang, 0, pos, leaf, count(*) over (partition by lang) from placed")}, subroots as (
  select 0 as one, tree as lang, node as subroot, row_number() over (order by tree nulls first) - 1 as pos from inner_nodes where n = 1
), {_levels_sql("top_nodes", "tree", "select one, 0, pos, subroot, count(*) over () from subroots")}, inner_paths as (
  {_steps_sql("inner_nodes", "placed", "r", "lang")}
), top_paths as (
  {_steps_sql("top_nodes", "subroots", "pos", "one")}
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
from (
  select p.doc_id, p.leaf, s.subroot, (select node from top_nodes where n = 1) as root, sha256(coalesce(i.proof, '') || coalesce(o.proof, '')) as proof_sha256,
         list_reduce(list_prepend([seen, ''], list_concat(coalesce(i.steps, []), coalesce(o.steps, []))), lambda acc, x: [sha256(x[1] || acc[1] || x[2]), ''])[1] as folded_root
  from placed p join subroots s on s.lang is not distinct from p.lang left join inner_paths i using (r) left join top_paths o on o.pos = s.pos
)
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), base=conv - conv % 20, head=F.crc32(conv.cast("string")) % 4)


OP12_SQL = f"""
with recursive {_CRC_TABLE}, own as (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as w
  from conversations where conv_id is not null group by conv_id
), heads as (
  select conv_id, w, ({_crc_sql("conv_id")} % 4)::int as h from own, crc_table
), rebuilt as (
  select c.conv_id, list_concat(coalesce(b.w[1:c.h], []), c.w[c.h + 1:]) as w from heads c left join own b on b.conv_id = c.conv_id - c.conv_id % 20
), prefixes as (
  select conv_id, d, w[1:d] as p, len(w) = d as ends from (select conv_id, w, unnest(range(0, len(w) + 1)) as d from rebuilt)
), nodes as (
  select d, p, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256,
         (count(*) - 1) * coalesce(len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')), 0) as saved
  from prefixes group by d, p
), childless as (
  select n.d, n.p, n.saved, c.p is null as leaf from nodes n left join (select distinct p[1:d - 1] as p from nodes where d > 0) c on c.p = n.p
), subtrees as (
  select up as d, p[1:up] as p, sum(saved) as saved, count(*) filter (leaf) as leaves, count(*) filter (d = up + 1) as children
  from (select *, unnest(range(0, d + 1)) as up from childless) group by up, p[1:up]
)
select n.conv_id, n.d as depth, f.conv_id as parent_conv_id, n.n_convs, s.children as n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens, n.ends_sha256
from nodes n join subtrees s using (d, p) left join nodes f on f.d = n.d - 1 and f.p = n.p[1:n.d - 1]
"""


def op13_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = private_spans.apply_private(docs, private_spans.fit_private(docs), redacted=False)
    fixed = F.filter("private_spans", lambda s: s["fixed"])
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{k}") for k in private_spans.KINDS]
    return found.withColumn("base", fixed).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("private_spans")).alias("spans"))


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_nnls_packing": op2_nnls_packing,
        "op3_hilbert_sharding": op3_hilbert_sharding,
        "op4_repair_ids": op4_repair_ids,
        "op5_greedy_tiling": op5_greedy_tiling,
        "op6_warc_index": op6_warc_index,
        "op7_quality_rules": op7_quality_rules,
        "op8_license_scan": op8_license_scan,
        "op9_parity_join": op9_parity_join,
        "op10_toxicity_crf": op10_toxicity_crf,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_private_spans": op13_private_spans,
    }


def oracle_sql() -> dict:
    return {"op1_url_filter": OP1_SQL, "op6_warc_index": OP6_SQL, "op8_license_scan": OP8_SQL, "op9_parity_join": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_prefix_trie": OP12_SQL}
