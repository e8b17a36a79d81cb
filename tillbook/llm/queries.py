"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import (
    anchor_pii,
    arrow_resampling,
    bin_packing,
    block_text,
    edit_counts,
    exact_dedup,
    factor_machine,
    prefix_trie,
    shard_tree,
    soft_mixing,
    spherical_cells,
    superminhash,
    url_rules,
)
from tillbook.llm.common import quality_and_toxicity_domains, table

#: 40 shards: 4 regions of 5 racks of 2.
SHARD_TREE = shard_tree.regular_tree(4, 5, 2)
#: Shares of expected tokens by domain.
MIXTURE = {"high": 0.8, "low": 0.15, "toxic": 0.05}
HOST_RULES = [
    url_rules.host_rule("block", "net/"),
    url_rules.host_rule("allow", "example.net/en/"),
    url_rules.host_rule("block", "example.com/de/"),
    url_rules.host_rule("allow", "org/fr/"),
]


def op1_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_pii.find_personal_data(table(spark, sf_dir, "documents"))


def op2_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_text.extract(table(spark, sf_dir, "pages"))


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_tree.shard_documents(table(spark, sf_dir, "documents"), SHARD_TREE)
    return rows.withColumn("law", F.lit("key"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return soft_mixing.rates(soft_mixing.fit(docs, quality_and_toxicity_domains(labels), MIXTURE))


def op7_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical_cells.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return factor_machine.score(docs, factor_machine.fit(docs, table(spark, sf_dir, "labels")))


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after three edits of each.

    The places of the edits follow from doc_id and the length of the text: a word is put
    in, a stretch is taken out, and the text's own beginning replaces another stretch.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))

    def at(number: int) -> Column:
        place = F.pmod(F.xxhash64("doc_id", F.lit(number)), F.greatest(F.length(text), F.lit(1)))
        return place.cast("int")

    edits = F.array(
        F.struct(at(1).alias("at"), F.lit(0).alias("removed"), F.lit(" amended\n").alias("inserted")),
        F.struct(at(2).alias("at"), F.lit(40).alias("removed"), F.lit("").alias("inserted")),
        F.struct(at(3).alias("at"), F.lit(7).alias("removed"), F.substring(text, 1, 20).alias("inserted")),
    )
    return edit_counts.recount(docs, edits)


def op11_arrow_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrow_resampling.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return rows.drop("n_words")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mined = url_rules.mine(url_rules.labelled_pages(pages, table(spark, sf_dir, "labels")))
    judged = url_rules.judge(pages, HOST_RULES, mined)
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_anchor_pii,
        op2_block_text,
        op3_superminhash,
        op4_shard_tree,
        op5_exact_dedup,
        op6_soft_mixing,
        op7_bin_packing,
        op8_spherical_cells,
        op9_factor_machine,
        op10_edit_counts,
        op11_arrow_resampling,
        op12_prefix_trie,
        op13_url_rules,
    )
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op11_arrow_resampling": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), target AS (
            SELECT unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM benchmark
        ), source AS (
            SELECT doc_id, unnest(w) AS word FROM words
        ), crc_of_byte AS (
            SELECT list_transform(range(256), lambda b: list_reduce(
                list_prepend(b, range(8)),
                lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END
            )) AS t
        ), names AS (
            SELECT word, hex(encode(word)) AS h
            FROM (SELECT word FROM source UNION SELECT word FROM target)
        ), buckets AS (
            SELECT word, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(1, length(h), 2),
                    lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
            FROM names, crc_of_byte
        ), here AS (
            SELECT bucket, count(*) AS n FROM source JOIN buckets USING (word) GROUP BY bucket
        ), there AS (
            SELECT bucket, count(*) AS n FROM target JOIN buckets USING (word) GROUP BY bucket
        ), sums AS (
            SELECT (SELECT coalesce(sum(n), 0) FROM here)::DOUBLE AS s,
                   (SELECT coalesce(sum(n), 0) FROM there)::DOUBLE AS t
        ), gains AS (
            SELECT word, floor(1000 * ln((coalesce(there.n, 0) + 1.0::DOUBLE) * (s + 10000)
                / ((here.n + 1.0::DOUBLE) * (t + 10000))))::BIGINT AS gain
            FROM buckets JOIN here USING (bucket) LEFT JOIN there USING (bucket), sums
        ), weights AS (
            SELECT doc_id, sum(gain)::BIGINT AS weight
            FROM source JOIN gains USING (word) GROUP BY doc_id
        ), scored AS (
            SELECT words.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   (coalesce(weight, 0) + floor(-1000 * ln(-ln(
                       (('0x' || substr(sha256('2024:' || words.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                       / 4294967296))))::BIGINT AS score
            FROM words LEFT JOIN weights USING (doc_id)
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth,
                   count(*) OVER () * 10 // 100 AS k
            FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN nth <= k THEN nth END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)
    """,
    "op12_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
                   sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT conv_id, list(id ORDER BY turn NULLS FIRST, substr(id, 1, 32), chars) AS ids,
                   list(chars ORDER BY turn NULLS FIRST, substr(id, 1, 32), chars) AS lens
            FROM turns GROUP BY conv_id
        ), crc_of_byte AS (
            SELECT list_transform(range(256), lambda b: list_reduce(
                list_prepend(b, range(8)),
                lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END
            )) AS t
        ), drawn AS (
            SELECT conv_id, ids, lens, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(1, length(x), 2),
                    lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 6 AS h
            FROM (SELECT *, hex(encode(conv_id::VARCHAR)) AS x FROM convs), crc_of_byte
        ), rebuilt AS (
            SELECT d.conv_id,
                   list_concat(coalesce(b.ids, [])[1:h], d.ids[h + 1:]) AS ids,
                   list_concat(coalesce(b.lens, [])[1:h], d.lens[h + 1:]) AS lens
            FROM drawn d LEFT JOIN convs b ON b.conv_id = d.conv_id - d.conv_id % 100
        ), prefixes AS (
            SELECT conv_id, len(ids) AS n, ids, lens, unnest(range(len(ids) + 1)) AS depth FROM rebuilt
        ), nodes AS (
            SELECT ids[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   (count(*) - 1) * coalesce(any_value(lens[depth]), 0) AS saved,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                       FILTER (WHERE n = depth), '')) AS ends_sha256
            FROM prefixes GROUP BY ALL
        ), children AS (
            SELECT path[1:depth - 1] AS path, count(*) AS n_children
            FROM nodes WHERE depth > 0 GROUP BY 1
        ), counted AS (
            SELECT nodes.*, coalesce(n_children, 0) AS n_children
            FROM nodes LEFT JOIN children USING (path)
        ), subtrees AS (
            SELECT path[1:up] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
                   sum(saved)::BIGINT AS saved_tokens
            FROM (SELECT path, n_children, saved, unnest(range(depth + 1)) AS up FROM counted)
            GROUP BY 1
        )
        SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
               n_leaves, saved_tokens, c.ends_sha256
        FROM counted c JOIN subtrees s ON s.path = c.path
        LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[1:c.depth - 1]
    """,
    "op13_url_rules": r"""
        WITH split AS (
            SELECT page_id, url,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), parts AS (
            SELECT page_id, url, host, path,
                   string_split(host, '.') AS labels,
                   regexp_replace(regexp_replace(path, '(?s)\.[^./]+$', ''), '[0-9]+', '0', 'g') AS body
            FROM split
        ), found AS (
            SELECT page_id, url, host, path, CASE WHEN contains(url, '://') THEN list_sort(list_distinct(
                list_transform(list_filter(flatten([
                    [['s', string_split(url, '://')[1]]],
                    list_transform(labels, lambda x: ['h', x]),
                    list_transform(flatten(list_transform(list_filter(labels, lambda x: contains(x, '-')),
                        lambda x: string_split(x, '-'))), lambda x: ['w', x]),
                    list_transform(string_split(body, '/'), lambda x: ['p', x]),
                    [['x', regexp_extract(path, '(?s)\.([^./]+)$', 1)]],
                    list_transform(regexp_split_to_array(
                        regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '[&;]'),
                        lambda x: ['q', string_split(x, '=')[1]])
                ]), lambda x: x[2] <> ''),
                lambda x: x[1] || ':' || translate(x[2], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            ))) ELSE [] END AS tokens
            FROM parts
        ), labelled AS (
            SELECT tokens, (toxic = 1 OR quality = 0)::INT AS unwanted
            FROM found JOIN labels ON doc_id = page_id
            WHERE (toxic = 1 OR quality = 0) IS NOT NULL
        ), subsets AS (
            SELECT unwanted, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS antecedent
            FROM (SELECT tokens, unwanted, unnest(range(1, 1 << len(tokens))) AS m FROM labelled)
        ), mined AS (
            SELECT antecedent FROM subsets GROUP BY antecedent
            HAVING sum(unwanted) >= greatest(20, 0.001 * (SELECT count(*) FROM labelled))
               AND sum(unwanted) / count(*) >= 0.6
        ), listed AS (
            SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t (verdict, site, start)
        ), judged AS (
            SELECT found.*, (
                SELECT max({'n': length(site || start), 'rule': site || start, 'verdict': listed.verdict}) FROM listed
                WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start)
            ) AS best
            FROM found
        )
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN EXISTS (
            SELECT 1 FROM mined WHERE list_has_all(tokens, antecedent)) THEN 'block' ELSE 'allow' END) AS verdict
        FROM judged
    """,
    "op5_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
            FROM documents
        ), groups AS (
            SELECT body, min(doc_id) AS keep_id, count(*) AS group_size
            FROM texts GROUP BY body
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM texts JOIN groups USING (body)
    """,
    "op4_shard_tree": r"""
        WITH u AS (
            SELECT doc_id, text, name,
                   -ln((('0x' || substr(md5(name || '/' || doc_id), 1, 12))::BIGINT + 0.5)
                       / 281474976710656.0) AS draw
            FROM documents, (
                SELECT unnest(list_concat(
                    list_transform(range(4), lambda g: 'g' || g),
                    list_transform(range(20), lambda r: 'g' || (r // 5) || 'r' || (r % 5)),
                    list_transform(range(40), lambda s: 's' || s),
                    ['g-40'])) AS name)
        ), draws AS (
            SELECT doc_id, map_from_entries(list((name, draw))) AS d FROM u GROUP BY doc_id
        ), regions AS (
            SELECT doc_id, d, list_sort(list_transform(range(4), lambda g:
                {'v': d['g' || g] / 10, 'g': g}))[1] AS best
            FROM draws
        ), racks AS (
            SELECT doc_id, d, best, list_sort(list_transform(range(5), lambda r:
                {'v': d['g' || best.g || 'r' || r] / 2, 'r': best.g * 5 + r}))[1].r AS rack
            FROM regions
        ), placed AS (
            SELECT doc_id, list_sort(list_transform(range(2), lambda s:
                {'v': d['s' || (rack * 2 + s)], 's': rack * 2 + s}))[1].s::INT AS shard,
                d['g-40'] < best.v AS moves
            FROM racks
        ), crc_of_byte AS (
            SELECT list_transform(range(256), lambda b: list_reduce(
                list_prepend(b, range(8)),
                lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END
            )) AS t
        ), sized AS (
            SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
                   hex(encode(coalesce(text, ''))) AS h FROM documents
        ), summed AS (
            SELECT doc_id, size, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(1, length(h), 2),
                    lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
            FROM sized, crc_of_byte
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
               row_number() OVER (
                   PARTITION BY shard
                   ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 16, doc_id
               ) - 1 AS slot,
               CASE WHEN moves THEN 40 ELSE shard END AS grown_shard
        FROM placed JOIN summed USING (doc_id)
    """,
}
