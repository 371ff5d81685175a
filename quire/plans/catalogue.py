"""Named queries over the relational tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import codecs, crypto, flags, formats, glyphs, text
from quire.operators import forms, layout, mutations, relational, signatures
from quire.operators.shared import small_batches
from quire.sources import documents as pdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader; its name is the query's."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return build(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[build.__name__] = run
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


@query("""SELECT min(k) AS start, count(*) AS n FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 25)) GROUP BY g""")
def q01_islands(t):
    return relational.islands(t("lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("k")), "k")


@query("""SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def q02_latest_version(t):
    return relational.latest(t("events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("""SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM documents""")
def q03_byte_offsets(t):
    return relational.running_offset(t("documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"])


@query("""SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 10, '0') || ' ' || lpad((o_custkey % 65536)::VARCHAR, 5, '0') || CASE WHEN o_orderstatus = 'O' THEN ' n' ELSE ' f' END AS line FROM orders""")
def q04_xref_line(t):
    return t("orders").select("o_orderkey", relational.xref_line(F.col("o_orderkey"), F.col("o_custkey") % 65536, F.col("o_orderstatus") == "O").alias("line"))


@query("""SELECT o_orderkey, '01' || lpad(upper(to_hex(o_orderkey)), 8, '0') || lpad(upper(to_hex(o_custkey % 65536)), 4, '0') AS record FROM orders""")
def q05_xref_record(t):
    return t("orders").select("o_orderkey", relational.fixed_width([(F.lit(1), 1), (F.col("o_orderkey"), 4), (F.col("o_custkey") % 65536, 2)]).alias("record"))


@query("""SELECT ((rn - 1) // 100)::BIGINT AS batch, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part) GROUP BY 1""")
def q06_batches(t):
    rows = relational.batched(t("part").select("p_partkey"), ["p_partkey"], 100)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


@query("""SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q07_priority_union(t):
    first = t("labels").select("doc_id", F.lit("label").alias("origin"))
    return relational.union_first(first, t("documents").select("doc_id", F.lit("document").alias("origin")), ["doc_id"])


@query("""SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""")
def q08_missing_references(t):
    return relational.missing(t("documents").select("doc_id"), t("labels").select("doc_id"), ["doc_id"])


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%-d-%b-%y') AS short FROM orders""")
def q09_printd(t):
    when = F.col("o_orderdate")
    return t("orders").select("o_orderkey", formats.printd("mm/dd/yyyy", when).alias("us"), formats.printd("d-mmm-yy", when).alias("short"))


@query("""SELECT o_orderkey, format('{:,.2f}', round(o_totalprice::DECIMAL(18, 6), 2)::DECIMAL(18, 2)::DOUBLE) AS price FROM orders""")
def q10_number_format(t):
    return t("orders").select("o_orderkey", formats.number_format(F.col("o_totalprice").cast("decimal(18,6)"), 2).alias("price"))


@query("""SELECT c_custkey, '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) AS phone FROM (SELECT c_custkey, lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '5') AS d FROM customer)""")
def q11_phone(t):
    number = F.lpad((F.col("c_custkey") * 7919 % 10000000000).cast("string"), 10, "5")
    return t("customer").select("c_custkey", formats.special_format(number, 2).alias("phone"))


@query("""SELECT l_orderkey, l_linenumber, (f & 1) <> 0 AS read_only, (f & 4096) <> 0 AS multiline, f | 2 AS required_set, f & ~4 AS no_export_cleared FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 31 + l_suppkey) AS f FROM lineitem)""")
def q12_flags(t):
    f = F.col("l_partkey") * 31 + F.col("l_suppkey")
    return t("lineitem").select("l_orderkey", "l_linenumber", flags.has(f, flags.FIELD["readOnly"]).alias("read_only"), flags.has(f, flags.FIELD["multiline"]).alias("multiline"), flags.with_flag(f, 2).alias("required_set"), flags.with_flag(f, 4, False).alias("no_export_cleared"))


@query("""SELECT o_orderstatus, round(sum(o_totalprice::DECIMAL(20, 2)), 2)::DOUBLE AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) AS n FROM orders GROUP BY 1""")
def q13_calculate(t):
    price = F.col("o_totalprice")
    return t("orders").groupBy("o_orderstatus").agg(relational.simple_calculate(price.cast("decimal(20,2)"), "SUM").cast("double").alias("total"), relational.simple_calculate(price, "MIN").alias("least"), relational.simple_calculate(price, "MAX").alias("most"), F.count(F.lit(1)).alias("n"))


def pixels(t) -> DataFrame:
    """(vec_id, i, x): each vector as a row of bytes."""
    rows = t("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.select("vec_id", "i", F.pmod(F.floor(F.col("v").cast("double") * 1000), F.lit(256)).alias("x"))


PIXELS = "px AS (SELECT vec_id, (i - 1)::INTEGER AS i, (((floor(v::DOUBLE * 1000)::BIGINT % 256) + 256) % 256)::BIGINT AS x FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"


@query(f"""WITH {PIXELS} SELECT vec_id, i, ((x - coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY i), 0) + 256) % 256)::BIGINT AS y FROM px""")
def q14_tiff_encode(t):
    return pixels(t).select("vec_id", "i", relational.tiff_encode(F.col("x"), ["vec_id"], "i").alias("y"))


@query(f"""WITH {PIXELS} SELECT vec_id, i, (sum(x) OVER (PARTITION BY vec_id ORDER BY i) % 256)::BIGINT AS y FROM px""")
def q15_tiff_decode(t):
    return pixels(t).select("vec_id", "i", relational.tiff_decode(F.col("x"), ["vec_id"], "i").alias("y"))


@query(f"""WITH {PIXELS}, up AS (SELECT vec_id, i, ((x - coalesce(lag(x, 16) OVER (PARTITION BY vec_id ORDER BY i), 0) + 256) % 256)::BIGINT AS y FROM px) SELECT vec_id, string_agg(CASE WHEN i % 16 = 0 THEN '02' ELSE '' END || lpad(upper(to_hex(y)), 2, '0'), '' ORDER BY i) AS coded, TRUE AS back FROM up GROUP BY vec_id""")
def q16_png_up(t):
    rows = t("embeddings").select("vec_id", F.transform("embedding", lambda v: F.pmod(F.floor(v.cast("double") * 1000), F.lit(256)).cast("int")).alias("x"))
    packed = F.unhex(F.array_join(F.transform("x", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    coded = codecs.predictor_encode(packed, 12, 16)
    return rows.select("vec_id", F.hex(coded).alias("coded"), (codecs.predictor_decode(coded, 12, 16) == packed).alias("back"))


@query("""SELECT page_id, regexp_extract(html, '(?s)<title(?:\\s[^>]*)?>(.*?)</title>', 1) AS title FROM pages""")
def q17_xml_content(t):
    return t("pages").select("page_id", text.xml_content(F.col("html"), "title").alias("title"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS digest FROM pages""")
def q18_xml_escape(t):
    return t("pages").select("page_id", F.md5(text.xml_escape(F.col("html"))).alias("digest"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '__(.+?)__', '\\1', 'g'), '~~(.+?)~~', '\\1', 'g')) AS digest FROM documents""")
def q19_markdown_plain(t):
    return t("documents").select("doc_id", F.md5(text.markdown_plain(F.col("text"))).alias("digest"))


@query("""SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7F\\x{A0}-\\x{FF}•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž]') AS unicode, length(text)::INTEGER AS n FROM documents""")
def q20_document_encoding(t):
    return t("documents").select("doc_id", text.needs_unicode(F.col("text")).alias("unicode"), F.octet_length(text.doc_encode(F.col("text"))).alias("n"))


@query("""SELECT doc_id, (2 + 2 * length(text) + 2 * length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')))::INTEGER AS n FROM documents""")
def q21_utf16(t):
    return t("documents").select("doc_id", F.octet_length(text.utf16be(F.col("text"))).alias("n"))


@query("""SELECT doc_id, strlen(text)::INTEGER AS n_bytes, length(text)::INTEGER AS n_points FROM documents""")
def q22_utf8_length(t):
    return t("documents").select("doc_id", F.octet_length(text.utf8(F.col("text"))).alias("n_bytes"), F.length("text").alias("n_points"))


@query("""SELECT doc_id, md5(hex(encode(text)) || '>') AS digest, (2 * strlen(text) + 1)::INTEGER AS n FROM documents""")
def q23_hex_encode(t):
    coded = codecs.encode(text.utf8(F.col("text")), "ASCIIHexDecode")
    return t("documents").select("doc_id", F.md5(coded).alias("digest"), F.octet_length(coded).alias("n"))


@query("""SELECT doc_id, upper(md5(text)) AS md5, upper(sha256(text)) AS sha256, upper(sha1(text)) AS sha1 FROM documents""")
def q24_hashes(t):
    data = text.utf8(F.col("text"))
    return t("documents").select("doc_id", *[text.hex_upper(crypto.digest(data, a)).alias(a) for a in ("md5", "sha256", "sha1")])


@query("""SELECT page_id, string_agg(CASE WHEN regexp_full_match(c, '[+,A-Za-z0-9_.-]') THEN c ELSE '#' || upper(lpad(to_hex(unicode(c)), 2, '0')) END, '' ORDER BY i) AS name FROM (SELECT page_id, unnest(string_split(url, '')) AS c, generate_subscripts(string_split(url, ''), 1) AS i FROM pages) GROUP BY page_id""")
def q25_name_escape(t):
    return t("pages").select("page_id", text.name_escape(F.col("url")).alias("name"))


@query("""SELECT r_name AS path, 0 AS depth FROM region UNION ALL SELECT r_name || '.' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q26_tree_paths(t):
    regions = t("region").select(F.lit(0).alias("doc_id"), F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nations = t("nation").select(F.lit(0).alias("doc_id"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return relational.tree_paths(regions.unionByName(nations)).select("path", "depth")


@query("""SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice * 4 < o_totalprice""")
def q27_join_residual(t):
    return relational.joined_by_number(t("orders"), t("lineitem"), "o_orderkey", "l_orderkey", F.col("l_extendedprice") * 4 < F.col("o_totalprice")).select("o_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT o_orderkey, c_name, row_number() OVER (ORDER BY o_orderkey)::INTEGER AS position FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def q28_ordered_lookup(t):
    return relational.ordered_lookup(t("orders").select("o_orderkey", "o_custkey"), t("customer"), "o_custkey", "c_custkey", ["o_orderkey"]).select("o_orderkey", "c_name", "position")


@query("""SELECT p_partkey, low, width FROM part JOIN (VALUES (1, 9), (10, 11), (21, 5), (26, 30)) r(low, width) ON p_size >= low AND p_size < low + width""")
def q29_range_join(t):
    part = t("part").select("p_partkey", "p_size")
    ranges = part.sparkSession.createDataFrame([(1, 9), (10, 11), (21, 5), (26, 30)], "low int, width int")
    return relational.in_ranges(part, "p_size", ranges, "low", "width", 8).select("p_partkey", "low", "width")


@query("""SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def q30_distinct_content(t):
    return relational.distinct_content(t("documents"), F.col("text"), "doc_id")


@query("""SELECT conv_id, role, max_by(md5(text), turn) AS digest FROM conversations GROUP BY 1, 2""")
def q31_last_value(t):
    return t("conversations").groupBy("conv_id", "role").agg(relational.found_last(F.md5("text"), F.col("turn")).alias("digest"))


@query("""SELECT conv_id, max(turn) AS last_turn, max_by(role, turn) AS last_role, max(CASE WHEN turn = 1 THEN md5(text) END) AS second, min_by(CASE WHEN role = 'assistant' THEN md5(text) END, CASE WHEN role = 'assistant' THEN turn END) AS answer FROM conversations GROUP BY 1""")
def q32_positions(t):
    turn = F.col("turn")
    return t("conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), relational.found_last(F.col("role"), turn).alias("last_role"), relational.at_position(F.md5("text"), turn, 1).alias("second"), relational.found_first(F.md5("text"), turn, F.col("role") == "assistant").alias("answer"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), chr(8), '\\b'), chr(12), '\\f'), '(', '\\('), ')', '\\)')) AS digest FROM documents""")
def q33_escape_string(t):
    return t("documents").select("doc_id", F.md5(text.escape_string(F.col("text"))).alias("digest"))


@query("""SELECT p_partkey, 'F' || (p_size % 4) AS font, p_size::DOUBLE AS size, CASE WHEN p_size % 2 = 0 THEN '0 0 1 rg' ELSE '0 g' END AS color FROM part""")
def q34_default_appearance(t):
    da = F.concat(F.lit("/F"), F.col("p_size") % 4, F.lit(" "), F.col("p_size"), F.lit(" Tf"), F.when(F.col("p_size") % 2 == 0, F.lit(" 0 0 1 rg")).otherwise(F.lit("")))
    return t("part").select("p_partkey", text.default_appearance(da).alias("a")).select("p_partkey", "a.font", "a.size", "a.color")


@query("""SELECT doc_id, '78' AS head, strlen(text) > 500 AS smaller, md5(text) AS digest FROM documents""")
def q36_flate(t):
    data = text.utf8(F.col("text"))
    coded = codecs.encode(data, "FlateDecode")
    smaller = (F.octet_length(data) > 500) & (F.octet_length(coded) < F.octet_length(data))
    return t("documents").select("doc_id", F.hex(F.substring(coded, 1, 1)).alias("head"), smaller.alias("smaller"), F.md5(codecs.decode(coded, "FlateDecode")).alias("digest"))


@query("""SELECT doc_id, md5(text) AS ascii85, md5(text) AS lzw, md5(text) AS run_length, md5(text) AS hex, TRUE AS other FROM documents""")
def q37_codecs(t):
    data = text.utf8(F.col("text"))
    names = {"ascii85": "ASCII85Decode", "lzw": "LZWDecode", "run_length": "RunLengthDecode"}
    coded = {a: codecs.encode(data, n) for a, n in names.items()}
    # the hex digits are another's, and no coded form may be the plain one
    other = (coded["ascii85"] != data) & (coded["lzw"] != data) & (coded["run_length"] != data) | (F.octet_length(data) == 0)
    return t("documents").select("doc_id", *[F.md5(codecs.decode(coded[a], n)).alias(a) for a, n in names.items()], F.md5(codecs.decode(F.encode(F.lower(F.hex(data)), "US-ASCII"), "ASCIIHexDecode")).alias("hex"), other.alias("other"))


@query("""SELECT doc_id, md5(text) AS rc4, md5(text) AS aes, (16 + (strlen(text) // 16 + 1) * 16)::INTEGER AS sealed, TRUE AS other FROM documents""")
def q38_ciphers(t):
    data, key = text.utf8(F.col("text")), F.unhex(F.md5(F.col("doc_id").cast("string")))
    ciphered, sealed = crypto.rc4(data, key), crypto.aes_cbc_encrypt(data, key)
    return t("documents").select("doc_id", F.md5(crypto.rc4(ciphered, key)).alias("rc4"), F.md5(crypto.aes_cbc_decrypt(sealed, key)).alias("aes"), F.octet_length(sealed).alias("sealed"), ((ciphered != data) | (F.octet_length(data) == 0)).alias("other"))


@query("""SELECT c_custkey, upper(substr(md5(unhex(md5('k') || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || '0000')), 1, 32)) AS object_key FROM (SELECT c_custkey, lpad(to_hex(c_custkey), 8, '0') AS h FROM customer)""")
def q39_object_key(t):
    return t("customer").select("c_custkey", F.hex(crypto.object_key(F.unhex(F.md5(F.lit("k"))), F.col("c_custkey"), F.lit(0))).alias("object_key"))


@query("""SELECT p_partkey, round(sum(CASE WHEN c = ' ' THEN 250 WHEN c BETWEEN 'A' AND 'Z' THEN 750 WHEN c BETWEEN 'a' AND 'z' THEN 500 WHEN c BETWEEN '0' AND '9' THEN 600 ELSE 400 END) * 12 / 1000.0, 6)::DOUBLE AS width FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY 1""")
def q40_text_width(t):
    return t("part").select("p_partkey", F.round(layout.text_width(F.col("p_name"), layout.plain_widths(), 12.0), 6).alias("width"))


WIDE = "coalesce(list_sum(list_transform(string_split(regexp_extract(acc, '[^' || chr(10) || ']*$') || ' ' || w, ''), lambda c: CASE WHEN c = ' ' THEN 250 WHEN c BETWEEN 'A' AND 'Z' THEN 750 WHEN c BETWEEN 'a' AND 'z' THEN 500 WHEN c BETWEEN '0' AND '9' THEN 600 ELSE 400 END)), 0)"
WRAPPED = f"list_reduce(string_split(t, ' '), lambda acc, w: acc || CASE WHEN {WIDE} * SIZE <= 150000 THEN ' ' ELSE chr(10) END || w)"


@query(f"""SELECT item_id, {WRAPPED.replace("SIZE", "10")} AS lines, list_max(list_filter(range(1, 25), lambda h: h = 1 OR len(string_split({WRAPPED.replace("SIZE", "h / 2.0")}, chr(10))) * h / 2.0 * 1.2 <= 60)) / 2.0 AS size FROM (SELECT item_id, regexp_replace(text, '[^a-zA-Z0-9. ]', 'x', 'g') AS t FROM benchmark)""")
def q41_wrap_and_fit(t):
    """Lines of at most 150 units, and the largest size at which they are at most 60 high; no word is wider than a line."""
    rows = t("benchmark").select("item_id", F.regexp_replace("text", "[^a-zA-Z0-9. ]", "x").alias("t"))
    return rows.select("item_id", F.array_join(layout.wrap_text(F.col("t"), 150.0, 10.0), "\n").alias("lines"), layout.fitting_size(F.col("t"), 150.0, 60.0).alias("size"))


@query("""SELECT doc_id, 1 AS n_pages, 5 AS n_objects, md5(text) AS digest FROM documents""")
def q42_write_and_read(t):
    files = pdf.write(t("documents").select("doc_id", "text"))
    return pdf.page_texts(files)


@query("""SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day, TRUE AS number_ok, c_custkey % 2 = 0 AS phone_ok FROM orders JOIN customer ON o_custkey = c_custkey""")
def q43_parse_and_validate(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = formats.scand("mm/dd/yyyy", formats.printd("mm/dd/yyyy", F.col("o_orderdate")))
    phone = F.rpad(F.lit("5"), 8, "5")
    return joined.select("o_orderkey", day.cast("timestamp_ntz").alias("day"), formats.number_valid(formats.number_format(F.col("o_totalprice"), 2)).alias("number_ok"), formats.special_valid(F.when(F.col("c_custkey") % 2 == 0, F.lit("555 123-4567")).otherwise(phone), 2).alias("phone_ok"))


@query("""SELECT p_partkey, least(p_size, 25) AS x1, least(p_partkey % 50, 10) AS y1, greatest(p_size, 25) AS x2, greatest(p_partkey % 50, 10) AS y2, greatest(p_size, 25) - least(p_size, 25) AS width, greatest(p_partkey % 50, 10) - least(p_partkey % 50, 10) AS height FROM part""")
def q44_rectangles(t):
    return t("part").select("p_partkey", formats.rect(F.col("p_size"), F.col("p_partkey") % 50, F.lit(25), F.lit(10).cast("long")).alias("r")).select("p_partkey", "r.*")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, min(ts) AS begin, count(*) AS n FROM s GROUP BY 1, 2""")
def q45_sessions(t):
    return relational.sessions(t("events"), ["user_id"], "ts", "event_id", "30 MINUTES")


@query("""SELECT o_custkey, max(o_orderkey) + 1 AS size, greatest(1, ceil(length(to_binary(max(o_orderkey))) / 8.0))::INTEGER AS bytes FROM orders GROUP BY 1""")
def q46_index_size(t):
    return t("orders").groupBy("o_custkey").agg(relational.index_size(F.col("o_orderkey")).alias("size"), relational.field_width(F.col("o_orderkey")).alias("bytes"))


@query("""SELECT l_orderkey, exp(sum(ln(1 + l_tax)))::DECIMAL(18, 6)::DOUBLE AS product, coalesce(avg(l_quantity), 0)::DECIMAL(18, 6)::DOUBLE AS mean FROM lineitem GROUP BY 1""")
def q47_product(t):
    product = relational.simple_calculate(1 + F.col("l_tax"), "PRD")
    return t("lineitem").groupBy("l_orderkey").agg(product.cast("decimal(18,6)").cast("double").alias("product"), relational.simple_calculate(F.col("l_quantity"), "AVG").cast("decimal(18,6)").cast("double").alias("mean"))


@query("""WITH RECURSIVE e AS (SELECT l_orderkey AS a, min(l_partkey) AS b FROM lineitem GROUP BY 1), r AS (SELECT 1::BIGINT AS node UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT node FROM r""")
def q48_closure(t):
    edges = t("lineitem").groupBy(F.col("l_orderkey").alias("source")).agg(F.min("l_partkey").alias("target")).select(F.lit(0).alias("doc_id"), "source", "target")
    roots = edges.sparkSession.createDataFrame([(0, 1)], "doc_id int, node long")
    return relational.closure(edges, roots).select("node")


def paged_files(t) -> DataFrame:
    """A file for each eleven documents in a row, a page each, whose size and turn depend on the document."""
    rows = t("documents").select(F.floor(F.col("doc_id") / 11).alias("doc_id"), F.col("doc_id").alias("page_no"), "text", (100 + F.col("n_chars") % 700).alias("width"), (200 + F.col("doc_id") % 50).alias("height"), (F.col("doc_id") % 4 * 90).alias("rotate"))
    return pdf.write_pages(rows)


FILES = "f AS (SELECT doc_id // 11 AS doc_id, count(*) AS n, ceil(count(*) / 10.0)::BIGINT AS branches FROM documents GROUP BY 1)"


@query(f"""WITH {FILES} SELECT doc_id, 'dictionary' AS kind, n + branches + 3 AS n FROM f UNION ALL SELECT doc_id, 'stream', n FROM f""")
def q49_object_kinds(t):
    return pdf.objects(paged_files(t)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FILES} SELECT doc_id, 2 * n + branches + 4 AS entries, 2 * n + branches + 3 AS live, 0 AS first_free FROM f""")
def q50_index_entries(t):
    entries = pdf.xref_entries(paged_files(t))
    return entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.when(F.col("entry_type") == 1, 1).otherwise(0)).alias("live"), F.min(F.when(F.col("entry_type") == 0, F.col("obj_no"))).alias("first_free"))


@query("""SELECT doc_id // 11 AS doc_id, (row_number() OVER (PARTITION BY doc_id // 11 ORDER BY doc_id) - 1)::INTEGER AS page_no, (100 + n_chars % 700)::DOUBLE AS width, (200 + doc_id % 50)::DOUBLE AS height, (doc_id % 4 * 90)::INTEGER AS rotate FROM documents""")
def q51_pages(t):
    return pdf.pages(paged_files(t)).select("doc_id", "page_no", "width", "height", "rotate")


@query("""SELECT doc_id // 11 AS doc_id, count(*)::INTEGER AS n_pages, md5(string_agg(text, '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1""")
def q82_texts_of_pages(t):
    return pdf.page_texts(paged_files(t)).select("doc_id", "n_pages", "digest")


@query("""SELECT n_regionkey AS doc_id, sum(n_nationkey)::VARCHAR AS total, (2 * sum(n_nationkey))::VARCHAR AS twice FROM nation GROUP BY 1""")
def q52_calculation_order(t):
    nation = t("nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("value"))
    docs = nation.groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    empty = docs.select("doc_id", F.explode(F.array(F.lit("total"), F.lit("twice"))).alias("name"), F.lit(None).cast("string").alias("value"))
    first = docs.select("doc_id", F.lit(0).alias("position"), F.lit("total").alias("target"), F.lit("SUM").alias("operation"), F.col("names").alias("sources"))
    second = docs.select("doc_id", F.lit(1).alias("position"), F.lit("twice").alias("target"), F.lit("sum").alias("operation"), F.array(F.lit("total"), F.lit("total")).alias("sources"))
    done = forms.calculated(nation.unionByName(empty), first.unionByName(second))
    return done.groupBy("doc_id").agg(F.max(F.when(F.col("name") == "total", F.col("value"))).alias("total"), F.max(F.when(F.col("name") == "twice", F.col("value"))).alias("twice"))


@query("""SELECT conv_id, role, max_by(md5(text), turn) AS digest FROM conversations WHERE role = 'user' GROUP BY 1, 2""")
def q53_export(t):
    rows = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("name"), F.md5("text").alias("value"), F.col("turn").alias("ordinal"))
    data = forms.exported(rows).select(F.col("doc_id").alias("conv_id"), F.explode("data").alias("role", "digest"))
    return data.filter("role = 'user'")


@query("""SELECT doc_id, 0::BIGINT AS r0, (n_chars // 3)::BIGINT AS r1, (n_chars // 3 + 66)::BIGINT AS r2, (n_chars + 100 - n_chars // 3 - 66)::BIGINT AS r3 FROM documents""")
def q54_byte_range(t):
    r = signatures.byte_range(F.floor(F.col("n_chars") / 3), F.lit(66), F.col("n_chars") + 100)
    return t("documents").select("doc_id", r.alias("r")).select("doc_id", *[F.col("r")[i].alias(f"r{i}") for i in range(4)])


@query("""WITH r AS (SELECT o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT o_custkey AS doc_id, (n - 1)::INTEGER AS revision_no, (n - 2)::INTEGER AS prev_no FROM r WHERE prev <> 0""")
def q55_prev_links(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("doc_id"), (F.row_number().over(w) - 1).alias("revision_no"), F.col("o_orderkey").alias("xref_offset"), F.lag("o_orderkey").over(w).alias("prev"))
    return relational.prev_links(rows)


@query("""SELECT p_partkey, rpad(hex(encode(p_name)), 400, '0') AS padded, CASE WHEN contains(p_brand, '#') THEN hex(encode(replace(p_brand, '#', '<>'))) END AS replaced FROM part""")
def q56_bytes(t):
    return t("part").select("p_partkey", F.hex(text.pad_bytes(text.utf8(F.col("p_name")), 200)).alias("padded"), F.hex(text.replace_bytes(text.utf8(F.col("p_brand")), b"#", b"<>", True)).alias("replaced"))


@query("""SELECT l_orderkey, l_linenumber, printf('%05d', l_partkey) AS part, 'D:' || strftime(l_shipdate, '%Y%m%d%H%M%S') || '+00' || chr(39) || '00' || chr(39) AS shipped, date_trunc('second', l_shipdate) AS back, l_quantity AS quantity FROM lineitem""")
def q57_formats(t):
    shipped = formats.document_date(F.col("l_shipdate"))
    quantity = formats.parse_numeric(F.concat(F.lit("qty: "), F.col("l_quantity").cast("string")))
    return t("lineitem").select("l_orderkey", "l_linenumber", formats.printf("%05d", F.col("l_partkey")).alias("part"), shipped.alias("shipped"), formats.parse_document_date(shipped).cast("timestamp_ntz").alias("back"), quantity.alias("quantity"))


@query("""SELECT DISTINCT n_regionkey AS region, r_name AS inherited FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q58_inheritance(t):
    regions = t("region").select(F.lit(1).alias("doc_id"), F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("v"), F.col("r_regionkey").alias("k"))
    nations = t("nation").select(F.lit(1).alias("doc_id"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit(None).cast("string").alias("v"), F.col("n_regionkey").alias("k"))
    return relational.inherited(nations, regions, ["v"]).select(F.col("k").alias("region"), F.col("v").alias("inherited")).distinct()


@query("""SELECT * FROM (VALUES ('rc4 Key', 'BBF316E8D940AF0AD3'), ('rc4 Wiki', '1021BF0420'), ('aes128 cbc', '7649ABAC8119B246CEE98E9B12E9197D'), ('aes256 ecb', '8EA2B7CA516745BFEAFC49904B496089'), ('lzw', '800B6050220C0C8501'), ('ascii85', '39 6A 71 6F 5E'), ('run length', '00 61 FB 62 02 63 64 65 80'), ('hex', '4D616E3E')) v(name, coded)""")
def q59_known_answers(t):
    """What public standards and encyclopedias give as examples."""
    one = t("region").limit(1)
    b = lambda digits: F.unhex(F.lit(digits))
    ascii_ = lambda said: F.encode(F.lit(said), "US-ASCII")
    spaced = lambda c: F.regexp_replace(F.hex(c), "(..)(?=.)", "$1 ")
    made = {
        "rc4 Key": F.hex(crypto.rc4(ascii_("Plaintext"), ascii_("Key"))),
        "rc4 Wiki": F.hex(crypto.rc4(ascii_("pedia"), ascii_("Wiki"))),
        "aes128 cbc": F.hex(crypto.aes_cbc_raw(b("6bc1bee22e409f96e93d7e117393172a"), b("2b7e151628aed2a6abf7158809cf4f3c"), b("000102030405060708090a0b0c0d0e0f"))),
        "aes256 ecb": F.hex(crypto.aes_ecb_block(b("00112233445566778899aabbccddeeff"), b("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"))),
        "lzw": F.hex(codecs.encode(b("2D2D2D2D2D412D2D2D42"), "LZWDecode")),
        "ascii85": spaced(codecs.encode(ascii_("Man "), "ASCII85Decode")),
        "run length": spaced(codecs.encode(ascii_("abbbbbbcde"), "RunLengthDecode")),
        "hex": F.hex(F.encode(F.lit("Man>"), "US-ASCII")),
    }
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("coded")) for n, c in made.items()])))
    return rows


def is_hidden(content: Column, said: Column) -> Column:
    """Whether neither the beginning of a plain content stream nor that of its text is in a file; a text under eight characters may be there by chance (and an empty one always is), so the former alone decides."""
    opening = F.contains(content, F.concat(F.encode(F.lit("720 Td ("), "US-ASCII"), F.unhex(F.lit("FEFF"))))
    return ~(opening | (F.length(said) >= 8) & F.contains(content, F.encode(F.substring(said, 1, 40), "UTF-16BE")))


@query("""SELECT doc_id, (doc_id % 4)::INTEGER AS kind, md5(text) AS digest, TRUE AS hidden FROM documents""")
def q60_protected_files(t):
    """Files of all four versions, read with the user's or the owner's password; the text can't be found in the file."""
    rows = t("documents").select("doc_id", "text")
    found = None
    for kind, version in enumerate((1, 2, 4, 5)):
        files = pdf.write(rows.filter(F.col("doc_id") % 4 == kind), version=version, password="user", owner="owner", revision=5).withColumn("password", F.when(F.col("doc_id") % 8 < 4, "user").otherwise("owner"))
        hidden = files.join(rows, "doc_id").select("doc_id", is_hidden(F.col("content"), F.col("text")).alias("hidden"))
        own = pdf.page_texts(files).select("doc_id", F.lit(kind).alias("kind"), "digest").join(hidden, "doc_id")
        found = own if found is None else found.unionByName(own)
    return found


@query("""SELECT doc_id, md5(text) AS digest, 4::BIGINT AS inside, 3::BIGINT AS apart FROM documents""")
def q61_object_and_index_streams(t):
    """Objects packed into a stream and an index as a stream: four of five objects fit, and the page's content, the object stream and the index stand for themselves."""
    files = pdf.write(t("documents").select("doc_id", "text"), compressed=True)
    entries = pdf.xref_entries(files).groupBy("doc_id").agg(F.count(F.when(F.col("entry_type") == 2, 1)).alias("inside"), F.count(F.when(F.col("entry_type") == 1, 1)).alias("apart"))
    return pdf.page_texts(files).select("doc_id", "digest").join(entries, "doc_id")


@query("""WITH i AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 200 END AS code, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS name FROM orders), g AS (SELECT *, count(code) OVER (PARTITION BY o_custkey ORDER BY i) AS grp FROM i), f AS (SELECT *, first_value(code) OVER (PARTITION BY o_custkey, grp ORDER BY i) AS base, row_number() OVER (PARTITION BY o_custkey, grp ORDER BY i) AS n FROM g) SELECT o_custkey, (base + n - 2)::INTEGER AS code, name FROM f WHERE name IS NOT NULL AND base IS NOT NULL""")
def q62_differences(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    items = t("orders").select("o_custkey", F.row_number().over(w).alias("i"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 200).alias("number"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("name"))
    return relational.differences(items, ["o_custkey"], "i", "number", "name").select("o_custkey", "code", "name")


@query("""SELECT * FROM (VALUES ('A', 'A'), ('Aacute', 'Á'), ('f_i.alt', 'fi'), ('uni00410042', 'AB'), ('u1F600', '😀'), ('alpha', 'α'), ('Euro', '€'), ('germandbls', 'ß'), ('nosuchglyph', NULL), ('ccedilla', 'ç'), ('quotedblleft', '“')) v(glyph, text)""")
def q63_glyph_names(t):
    wanted = ["A", "Aacute", "f_i.alt", "uni00410042", "u1F600", "alpha", "Euro", "germandbls", "nosuchglyph", "ccedilla", "quotedblleft"]
    rows = t("region").limit(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("glyph"))
    return rows.select("glyph", glyphs.glyph_to_text("glyph").alias("text"))


@query("""SELECT p_partkey, replace(replace(replace(p_name, 'a', 'Á'), 'e', '•'), chr(39), '’') AS text FROM part""")
def q64_decode_with_encoding(t):
    table = glyphs.encoding("StandardEncoding", {97: "Aacute", 101: "bullet"})
    return t("part").select("p_partkey", glyphs.decoded(F.encode("p_name", "US-ASCII"), table).alias("text"))


@query("""SELECT p_partkey, i::INTEGER AS i, round(coalesce(sum(w) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 12 / 1000.0 + 2, 6)::DOUBLE AS pen FROM (SELECT p_partkey, i, CASE WHEN c = ' ' THEN 250 WHEN c BETWEEN 'A' AND 'Z' THEN 750 WHEN c BETWEEN 'a' AND 'z' THEN 500 WHEN c BETWEEN '0' AND '9' THEN 600 ELSE 400 END AS w FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, generate_subscripts(string_split(p_name, ''), 1) - 1 AS i FROM part))""")
def q65_pen_positions(t):
    widths = F.create_map(*[F.lit(x) for c, w in layout.plain_widths().items() for x in (c, w)])
    rows = t("part").select("p_partkey", F.posexplode(F.filter(F.split("p_name", ""), lambda c: c != "")).alias("i", "c")).withColumn("w", F.coalesce(F.element_at(widths, F.col("c")), F.lit(400.0)))
    return relational.pen_positions(rows, ["p_partkey"], "i", "w", 12.0, 2.0).select("p_partkey", "i", F.round("pen", 6).alias("pen"))


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END, o_orderkey)::INTEGER AS position, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderkey) = 1 AS chosen, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3)::BIGINT AS chunk FROM orders""")
def q66_orders_and_choices(t):
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    status = F.col("o_orderstatus")
    placed = relational.written_order(rows, F.when(status == "P", 2).when(status == "O", 1).otherwise(0), ["o_custkey"], "o_orderkey")
    chosen = relational.radio_choice(placed, ["o_custkey"], "o_orderkey", status == "P")
    return relational.chunked(chosen, ["o_custkey"], "o_orderkey", 3).drop("o_orderstatus")


@query("""SELECT digest, min(origin)::INTEGER AS origin FROM (SELECT md5(p_brand) AS digest, 0 AS origin FROM part UNION ALL SELECT md5(p_type), 1 FROM part UNION ALL SELECT md5(p_brand), 2 FROM part) GROUP BY 1""")
def q67_union_of_revocation_data(t):
    part = t("part")
    return relational.union_distinct([part.select(F.md5(c).alias("digest")) for c in ("p_brand", "p_type", "p_brand")], "digest")


@query("""WITH RECURSIVE e AS (SELECT l_orderkey AS a, min(l_partkey) AS b FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1), r AS (SELECT n AS node, n AS pos, 0 AS d FROM range(1, 200) x(n) UNION ALL SELECT node, b, d + 1 FROM r JOIN e ON e.a = r.pos WHERE d < 32) SELECT node, max(CASE WHEN pos IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 5 = 0) THEN pos END) AS target FROM r GROUP BY 1 HAVING target IS NOT NULL""")
def q68_resolved_references(t):
    links = t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("next")).select(F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("obj_no"), F.when(F.col("l_orderkey") % 5 != 0, F.col("next")).alias("ref"))
    values = links.sparkSession.range(1, 200).select(F.lit(0).alias("doc_id"), F.col("id").alias("node"), F.col("id").alias("ref"))
    return relational.resolved(values, links).filter("target IS NOT NULL").select("node", "target")


def orders_as_objects(t) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return t("orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("revision_no"), F.row_number().over(w).alias("obj_no"), F.lit(0).alias("gen_no"), F.md5(F.col("o_orderkey").cast("string")).alias("value"), (F.col("o_orderkey") % 97 + 20).alias("size"))


OBJECTS = "o AS (SELECT o_custkey AS doc_id, 0 AS revision_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS obj_no, 0 AS gen_no, md5(o_orderkey::VARCHAR) AS value, o_orderkey % 97 + 20 AS size FROM orders)"


@query(f"""WITH {OBJECTS}, p AS (SELECT *, 15 + coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY obj_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM o WHERE obj_no % 4 <> 3), g AS (SELECT *, obj_no - row_number() OVER (PARTITION BY doc_id ORDER BY obj_no) AS run FROM p) SELECT doc_id, min(obj_no)::INTEGER AS first, count(*) AS n, md5(string_agg(lpad(pos::VARCHAR, 10, '0') || ' 00000 n', chr(10) ORDER BY obj_no)) AS digest FROM g GROUP BY doc_id, run""")
def q69_written_index(t):
    gone = orders_as_objects(t).filter("obj_no % 4 = 3").select("doc_id", "obj_no")
    objects = orders_as_objects(t)
    left, _ = mutations.deleted(objects, objects.select("doc_id", "obj_no", "gen_no", F.lit(1).alias("entry_type"), F.lit(0).alias("byte_offset")), gone)
    return mutations.indexed(mutations.placed(left, "size", ["obj_no"], 15)).select("doc_id", "first", "n", F.md5("lines").alias("digest"))


@query(f"""WITH {OBJECTS} SELECT doc_id, obj_no::INTEGER AS obj_no, CASE WHEN obj_no % 4 = 3 THEN 0 ELSE 1 END AS entry_type, CASE WHEN obj_no % 4 <> 3 THEN size END AS byte_offset, CASE WHEN obj_no % 4 = 3 THEN 1 ELSE 0 END AS gen_no FROM o""")
def q70_deleted_entries(t):
    objects = orders_as_objects(t)
    entries = objects.select("doc_id", "obj_no", "gen_no", F.lit(1).alias("entry_type"), F.col("size").alias("byte_offset"))
    _, left = mutations.deleted(objects, entries, objects.filter("obj_no % 4 = 3"))
    return left


@query(f"""WITH {OBJECTS}, n AS (SELECT doc_id, 1 AS revision_no, obj_no, 0 AS gen_no, md5(value) AS value FROM o WHERE size % 2 = 0), every AS (SELECT doc_id, revision_no, obj_no, value FROM o UNION ALL SELECT doc_id, revision_no, obj_no, value FROM n) SELECT doc_id, obj_no::INTEGER AS obj_no, max(revision_no)::INTEGER AS revision_no, max_by(value, revision_no) AS value FROM every GROUP BY 1, 2""")
def q71_incremental_revision(t):
    objects = orders_as_objects(t)
    changes = objects.filter("size % 2 = 0").withColumn("value", F.md5("value"))
    return relational.latest(mutations.incremental(objects, changes), ["doc_id", "obj_no"], [F.desc("revision_no")]).select("doc_id", "obj_no", "revision_no", "value")


@query(f"""WITH {OBJECTS}, c AS (SELECT c_custkey AS doc_id, c_nationkey, row_number() OVER (PARTITION BY c_custkey ORDER BY k) AS k FROM customer CROSS JOIN (VALUES (1), (2)) v(k)) SELECT c.doc_id, (coalesce(max(o.obj_no), 0) + c.k)::INTEGER AS obj_no FROM c LEFT JOIN o USING (doc_id) GROUP BY c.doc_id, c.k""")
def q72_next_numbers(t):
    new = t("customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return mutations.numbered(orders_as_objects(t), new, ["k"]).select("doc_id", "obj_no")


@query(f"""WITH {OBJECTS} SELECT doc_id, bool_or(size % 2 = 0) AS changed FROM o GROUP BY 1""")
def q73_modified(t):
    objects = orders_as_objects(t)
    return mutations.modified(objects.withColumn("value", F.when(F.col("size") % 2 == 0, F.md5("value")).otherwise(F.col("value"))), objects, "value")


@query("""SELECT p_partkey, i::INTEGER AS i, round(20.0 * (i + 0.5) - w * 10 / 2000.0, 6)::DOUBLE AS x FROM (SELECT p_partkey, i, CASE WHEN c = ' ' THEN 250 WHEN c BETWEEN 'A' AND 'Z' THEN 750 WHEN c BETWEEN 'a' AND 'z' THEN 500 WHEN c BETWEEN '0' AND '9' THEN 600 ELSE 400 END AS w FROM (SELECT p_partkey, unnest(string_split(substr(p_name, 1, 8), '')) AS c, generate_subscripts(string_split(substr(p_name, 1, 8), ''), 1) - 1 AS i FROM part))""")
def q74_comb(t):
    cells = layout.comb_positions(F.col("p_name"), F.lit(8), F.lit(160.0), 10.0, layout.plain_widths())
    return t("part").select("p_partkey", F.posexplode(cells).alias("i", "cell")).select("p_partkey", "i", F.round("cell.x", 6).alias("x"))


@query("""SELECT p_partkey, '<</Type /XObject /Subtype /Form /BBox [0 0 ' || CASE WHEN p_partkey % 2 = 1 THEN '20 ' || p_size ELSE p_size || ' 20' END || '] /Matrix [' || CASE p_partkey % 4 WHEN 1 THEN '0 1 -1 0 ' || p_size || ' 0' WHEN 2 THEN '-1 0 0 -1 ' || p_size || ' 20' WHEN 3 THEN '0 -1 1 0 0 20' ELSE '1 0 0 1 0 0' END || '] /Resources <<>>>>' AS head, round(CASE p_partkey % 3 WHEN 1 THEN (p_size - 7.5) / 2 WHEN 2 THEN p_size - 9.5 ELSE 2 END, 6)::DOUBLE AS x FROM part""")
def q75_form_objects(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    return t("part").select("p_partkey", layout.form_object(size, F.lit(20), key % 4 * 90).alias("head"), F.round(layout.quadded(size.cast("double"), F.lit(7.5), key % 3), 6).alias("x"))


@query("""SELECT doc_id, seq::INTEGER AS seq, substr(text, (seq * 1024 + 1)::BIGINT, 1024) AS piece, seq = n - 1 AS is_last FROM (SELECT doc_id, text, n, unnest(range(n)) AS seq FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS text, greatest(1, ceil(length(text) / 1024.0))::BIGINT AS n FROM documents))""")
def q76_chunks(t):
    plain = F.encode(F.regexp_replace("text", "[^ -~]", "?"), "US-ASCII")
    return relational.cut(t("documents").select("doc_id", plain.alias("content"))).select("doc_id", "seq", F.decode("data", "US-ASCII").alias("piece"), "is_last")


@query("""SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest, to_base64(encode(string_agg(role, '' ORDER BY turn))) AS roles FROM conversations GROUP BY 1""")
def q77_joined_bytes(t):
    rows = t("conversations").groupBy("conv_id").agg(relational.joined_bytes(text.utf8(F.col("text")), F.col("turn")).alias("all"), relational.joined_bytes(text.utf8(F.col("role")), F.col("turn")).alias("roles"))
    return rows.select("conv_id", F.md5("all").alias("digest"), text.base64_text(F.col("roles")).alias("roles"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_partkey % 131072 & 65536 <> 0 THEN 'push' WHEN p_partkey & 32768 <> 0 THEN 'radio' ELSE 'checkbox' END WHEN p_size % 4 = 1 THEN CASE WHEN p_partkey & 131072 <> 0 THEN 'combo' ELSE 'list' END WHEN p_size % 4 = 2 THEN 'signature' ELSE 'text' END AS kind FROM part""")
def q78_field_kinds(t):
    kind = F.when(F.col("p_size") % 4 == 0, "Btn").when(F.col("p_size") % 4 == 1, "Ch").when(F.col("p_size") % 4 == 2, "Sig").otherwise("Other")
    return t("part").select("p_partkey", forms.field_kind(kind, F.col("p_partkey")).alias("kind"))


@query("""WITH c AS (SELECT n_regionkey AS r, max_by(n_name, n_nationkey) AS v FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1) SELECT n_nationkey AS obj_no, coalesce(v, n_name) AS value, v IS NOT NULL AND v <> n_name AS dirty FROM nation LEFT JOIN c ON r = n_regionkey AND n_regionkey <> 3""")
def q79_propagated_values(t):
    nation = t("nation")
    fields = nation.select(F.lit(1).alias("doc_id"), F.col("n_nationkey").alias("obj_no"), F.lit(None).cast("int").alias("parent"), F.col("n_regionkey").cast("string").alias("name"), F.col("n_name").alias("value"))
    changes = nation.filter("n_nationkey % 2 = 0 AND n_regionkey <> 3").select(F.lit(1).alias("doc_id"), F.col("n_regionkey").cast("string").alias("name"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("ordinal"))
    return forms.propagated(fields, changes).select("obj_no", "value", "dirty")


@query("""SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey // 7)::INTEGER AS link, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER - 1 AS line, round(90.0 - (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 12.0, 6)::DOUBLE AS y FROM orders""")
def q80_links_and_lines(t):
    rows = t("orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_orderkey") / 7).alias("at"))
    placed = relational.line_positions(relational.linked(rows, ["o_custkey"], "at"), ["o_custkey"], "o_orderkey", 10.0, 100.0)
    return placed.select("o_orderkey", "link", "line", F.round("y", 6).alias("y"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS size FROM lineitem) SELECT doc_id, n, least(size, 400)::INTEGER AS bytes, TRUE AS differs FROM s""")
def q81_random_bytes(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.least("l_partkey", F.lit(400)).cast("int").alias("bytes"), crypto.random_bytes(400).alias("a"), crypto.random_bytes(400).alias("b"))
    cut_ = rows.withColumn("a", F.substring(F.col("a"), F.lit(1), F.col("bytes")))
    return cut_.select("doc_id", "n", F.octet_length("a").alias("bytes"), (F.col("a") != F.col("b")).alias("differs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
