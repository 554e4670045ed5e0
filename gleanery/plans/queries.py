"""Every query over the tables, by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.functions.dims import KINDS, NOT_DOMAINS, NOT_PEOPLE, POSED, REMOVABLE, RISKY, SHARED_SUFFIXES, finding_kinds, removal_contract
from gleanery.operators import counters, ranges, relate, reports, sniff, verify
from gleanery.plans.golden import CARVED, INSPECTED, MEMBERS, RECEIPTS, values

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _accounts(text: str) -> str:
    """Accounts of home paths, in SQL: each once whatever its case."""
    found = " , ".join(f"regexp_extract_all({text}, '{p}', 1)" for p in ("/Users/([A-Za-z0-9._ -]{1,64})/", "\\\\Users\\\\([A-Za-z0-9._ -]{1,64})\\\\", "/home/([A-Za-z0-9._ -]{1,64})/"))
    return f"list_filter(flatten([{found}]), lambda x: lower(x) NOT IN {_values(NOT_PEOPLE)})"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# ---- findings in texts

_RAW_MAIL = "regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,128})', 1)"


def _mails(excluded: bool) -> str:
    return f"""list_filter(list_transform({_RAW_MAIL}, lambda x: regexp_replace(regexp_replace(x, '^[.+-]+', ''), '[.-]+$', '')),
    lambda x: regexp_matches(split_part(x, '@', 1), '[A-Za-z]') AND regexp_matches(split_part(x, '@', 2), '\\.[A-Za-z]{{2,}}$')
      AND lower(regexp_extract(x, '([A-Za-z]+)$', 1)) NOT IN {_values(NOT_DOMAINS)} AND split_part(x, '@', 1) <> 'git'
      {"AND NOT suffix(x, 'example.com')" if excluded else ''})"""


def _distinct_first(list_sql: str) -> str:
    low = "list_transform(a, lambda y: lower(y))"
    return f"(SELECT list_filter(a, lambda x, i: list_position({low}, lower(x)) = i) FROM (SELECT {list_sql} AS a))"


def _mail_sql(excluded: bool, rows: str = "documents") -> str:
    return f"""
    WITH m AS (SELECT doc_id, {_mails(excluded)} AS a FROM {rows}),
    d AS (SELECT doc_id, list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i) AS a FROM m)
    SELECT doc_id, len(a) AS n, array_to_string(a[1:4], ', ') || CASE WHEN len(a) > 4 THEN ' and ' || (len(a) - 4) || ' more' ELSE '' END AS listed
    FROM d WHERE len(a) > 0"""


def _mail_rows(docs: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    found = docs.select("doc_id", X.emails(F.coalesce("text", F.lit("")), excluded).alias("a")).where(F.size("a") > 0)
    return found.select("doc_id", F.size("a").cast("long").alias("n"), X.listed(F.col("a")).alias("listed"))


@query(_mail_sql(False))
def emails_found(spark, sf_dir):
    return _mail_rows(table(spark, sf_dir, "documents"), ())


_SIGNED = """(SELECT doc_id, coalesce(text, '') || ' u' || doc_id || '@Mail' || (doc_id % 7) || '.site.org U' || doc_id || '@mail' || (doc_id % 7) || '.SITE.org '
  || CASE WHEN doc_id % 3 = 0 THEN 'a@x.net .b.c@y.net. git@z.net icon@2x.png 5@q.net d@w.net e@v.net ' ELSE 'me@example.com x@t.c1 ' END AS text FROM documents)"""


@query(_mail_sql(True, _SIGNED))
def emails_found_strict(spark, sf_dir):
    """Whole texts with a signature of several addresses, some of which are none."""
    i, s = F.col("doc_id"), lambda x: x.cast("string")
    more = F.when(i % 3 == 0, "a@x.net .b.c@y.net. git@z.net icon@2x.png 5@q.net d@w.net e@v.net ").otherwise("me@example.com x@t.c1 ")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" u"), s(i), F.lit("@Mail"), s(i % 7), F.lit(".site.org U"), s(i), F.lit("@mail"), s(i % 7), F.lit(".SITE.org "), more)
    return _mail_rows(table(spark, sf_dir, "documents").withColumn("text", said), ("example.com",))


_PATHS = [
    "built in /Users/olena/src and /Users/Olena/lib", "C:\\Users\\Ivan K\\x.psd, /home/runner/work/", "/home/vera/a /home/vera/b /Users/Shared/c",
]


@query(f"""
WITH t AS (SELECT 'd' || doc_id AS id, coalesce(text, '') || ' /Users/Ann ' || (doc_id % 50) || '/x /home/ann ' || (doc_id % 50) || '/ ' || CASE WHEN doc_id % 2 = 0 THEN '/home/runner/ \\Users\\B.o_b\\' ELSE '/Users/open' END AS text FROM documents
  UNION ALL SELECT * FROM (VALUES {', '.join(f"('p{i}', '{p}')" for i, p in enumerate(_PATHS))}) v(id, text)),
n AS (SELECT id, {_accounts("text")} AS a FROM t)
SELECT id, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), ', ') AS accounts
FROM n WHERE len(a) > 0""")
def accounts_in_paths(spark, sf_dir):
    """Whole texts with paths of home folders at their end, and some paths alone."""
    i = F.col("doc_id")
    end = F.when(i % 2 == 0, "/home/runner/ \\Users\\B.o_b\\").otherwise("/Users/open")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" /Users/Ann "), (i % 50).cast("string"), F.lit("/x /home/ann "), (i % 50).cast("string"), F.lit("/ "), end)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), said.alias("text"))
    more = spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(_PATHS)], "id string, text string")
    found = docs.unionByName(more).select("id", X.home_accounts(F.col("text")).alias("a")).where(F.size("a") > 0)
    return found.select("id", F.array_join("a", ", ").alias("accounts"))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPS = rf"list_distinct(regexp_extract_all(coalesce(text, ''), '\b({_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET})\b', 1))"


@query(rf"""
SELECT doc_id, address, regexp_matches(address, '^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)') AS private
FROM (SELECT doc_id, unnest({_IPS}) AS address FROM documents)""")
def addresses_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(X.ipv4(F.coalesce("text", F.lit("")))).alias("address"))
    return found.withColumn("private", X.private_ipv4(F.col("address")))


# ---- pages: links, hosts, words

_HOST = "nullif(regexp_extract({}, '(?i)^https?://(?:[^/?#]*@)?([^/?#:@]*)', 1), '')"
_BASE = f"""CASE WHEN array_to_string(string_split({{0}}, '.')[-2:], '.') IN {_values(SHARED_SUFFIXES)}
  THEN array_to_string(string_split({{0}}, '.')[-3:], '.') ELSE array_to_string(string_split({{0}}, '.')[-2:], '.') END"""


def _visible(x: str) -> str:
    gone = f"regexp_replace({x}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')"
    bare = f"regexp_replace({gone}, '<[^>]*>', ' ', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        bare = f"replace({bare}, '&{name};', '{char}')"
    return f"trim(regexp_replace({bare}, '[ \\t\\n\\r]+', ' ', 'g'))"


_LINKS = f"""
SELECT page_id, url, regexp_extract(a, '(?i)^<a\\s[^>]*?\\bhref\\s*=\\s*["'']([^"''>]*)["'']', 1) AS href, {_visible('a')} AS words
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)(<a\\s[^>]*>.*?</a>)', 1)) AS a FROM pages)"""


def _page_links(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.explode(X.links(F.col("html"))).alias("l")).select("page_id", "url", "l.href", "l.words")


@query(f"SELECT page_id, href, words FROM ({_LINKS}) WHERE href <> ''")
def page_links(spark, sf_dir):
    return _page_links(spark, sf_dir).drop("url")


@query(f"""
WITH h AS (SELECT lower({_HOST.format('url')}) AS host FROM pages),
b AS (SELECT {_BASE.format('host')} AS base FROM h WHERE host IS NOT NULL)
SELECT base, count(*) AS n FROM b GROUP BY base""")
def base_domain_counts(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select(X.host(F.col("url")).alias("host")).where("host is not null")
    return h.groupBy(X.base_domain(F.col("host")).alias("base")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, lower({_HOST.format('url')}) AS host FROM pages")
def link_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.host(F.col("url")).alias("host"))


_SAID = [("my-bank.com", "https://login.my-bank.com/x"), ("www.my-bank.com", "http://evil.example/my-bank.com"), ("click here", "https://a.b.co.uk/"),
         ("https://shop.co.uk/x", "https://other.co.uk"), ("pay.rozetka.com.ua", "https://rozetka.com.ua")]


_TO = "regexp_extract(lower(trim({})), '^https?://(?:[^/?#]*@)?([^/?#:@]*)', 1)"
_SITE = f"CASE WHEN contains({_TO}, '.') THEN regexp_replace({_TO}, '\\.+$', '') END"
_BARE = "regexp_extract(lower(regexp_replace(trim(words), '[/.,]+$', '')), '^([^/?#\\s]*)(?:[/?#]\\S*)?$', 1)"


@query(f"""WITH l AS (SELECT * FROM (VALUES {', '.join(f"('{w}', '{h}')" for w, h in _SAID)}) v(words, href) UNION ALL SELECT words, url FROM ({_LINKS}) WHERE href <> ''
  UNION ALL SELECT 'https://www.' || regexp_extract(lower(url), '^https?://([^/?#:]*)', 1) || '/' || page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://other' || page_id || '.org/' END FROM pages),
s AS (SELECT words, href, regexp_replace(coalesce({_SITE.format("regexp_replace(trim(words), '[/.,]+$', '')", "regexp_replace(trim(words), '[/.,]+$', '')")}, CASE WHEN regexp_matches({_BARE}, '^([a-z0-9-]+\\.)+[a-z]{{2,}}$') THEN {_BARE} END), '^(www\\.)+', '') AS said,
  {_SITE.format('href', 'href')} AS site FROM l)
SELECT words, href, coalesce({_BASE.format('said')} <> {_BASE.format('site')}, false) AS elsewhere FROM s""")
def link_mismatch(spark, sf_dir):
    """Links of pages; for each page its own address as words, that goes there or elsewhere; and some pairs."""
    links = _page_links(spark, sf_dir).select("words", F.col("url").alias("href"))
    i, at = F.col("page_id"), F.regexp_extract(F.lower("url"), "^https?://([^/?#:]*)", 1)
    named = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://www."), at, F.lit("/"), i).alias("words"), F.when(i % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://other"), i, F.lit(".org/"))).alias("href")
    )
    rows = spark.createDataFrame(_SAID, "words string, href string").unionByName(links).unionByName(named)
    return rows.withColumn("elsewhere", X.says_elsewhere(F.col("words"), X.host(F.col("href"))))


_NAMES = ["invoice.pdf.html", "setup.EXE", "photo.jpg", "macro.docm", "disk.iso", "a.lnk", "noext", "x.doc.js"]
_EXT = "regexp_extract(lower(name), '\\.([^.]*)$', 1)"


@query(f"""
WITH n AS (SELECT regexp_extract(href, '([^/]*)$', 1) AS name FROM ({_LINKS}) WHERE href <> '' UNION ALL SELECT unnest([{', '.join(f"'{n}'" for n in _NAMES)}])),
k AS (SELECT name, CASE {' '.join(f"WHEN {_EXT} IN {_values(v)} THEN '{k}'" for k, v in RISKY.items())} END AS kind, regexp_extract(lower(name), '([^.]*)\\.[^.]*$', 1) AS before FROM n)
SELECT name, kind || CASE WHEN before IN {_values(POSED)} AND regexp_matches(name, '\\..*\\.') THEN ' as ' || before ELSE '' END AS risk, count(*) AS n
FROM k WHERE kind IS NOT NULL GROUP BY ALL""")
def risky_targets(spark, sf_dir):
    names = _page_links(spark, sf_dir).select(F.regexp_extract("href", "([^/]*)$", 1).alias("name"))
    rows = names.unionByName(spark.createDataFrame([(n,) for n in _NAMES], "name string")).withColumn("risk", X.risky(F.col("name")))
    return rows.where("risk is not null").groupBy("name", "risk").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, length({_visible('html')}) AS chars, sha256({_visible('html')}) AS words_sha256 FROM pages")
def visible_words(spark, sf_dir):
    t = X.visible_words(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(t).cast("long").alias("chars"), F.sha2(F.encode(t, "UTF-8"), 256).alias("words_sha256"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '(?is)<!--.*?-->')) AS comments, len(regexp_extract_all(html, '(?is)<script\b.*?</script>')) AS scripts,
  len(regexp_extract_all(html, '(?is)<style\b.*?</style>')) AS styles FROM pages""")
def hidden_markup(spark, sf_dir):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select(
        "page_id", n("(?is)<!--.*?-->").alias("comments"), n(r"(?is)<script\b.*?</script>").alias("scripts"), n(r"(?is)<style\b.*?</style>").alias("styles")
    )


_CODES = ["WIFI:S:home;P:secret;;", "otpauth://totp/A:b?secret=X", "geo:50.4,30.5", "BEGIN:VCARD", "mailto:a@b.org", "https://bank.com@evil.example/",
          "http://10.0.0.1/", "https://xn--exmple-bank-zij.com", "https://bit.ly/x", "hello"]


@query(f"""
WITH c AS (SELECT unnest([{', '.join(f"'{c}'" for c in _CODES)}]) AS text UNION ALL SELECT coalesce(text, '') FROM conversations),
k AS (SELECT CASE WHEN regexp_matches(trim(text), '(?i)^WIFI:') THEN 'qrwifi' WHEN regexp_matches(trim(text), '(?i)^otpauth://') THEN 'qrsecret'
  WHEN regexp_matches(trim(text), '(?i)^geo:') THEN 'qrplace' WHEN regexp_matches(trim(text), '(?i)^(BEGIN:VCARD|MECARD:)') THEN 'qrcontact'
  WHEN regexp_matches(trim(text), '(?i)^https?://([^/?#]*@|[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+([:/?#]|$)|([^/?#]*\\.)?xn--)') THEN 'qrtrick'
  WHEN regexp_matches(trim(text), '(?i)^https?://.') THEN 'qrlink' ELSE 'qrtext' END AS kind FROM c)
SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def code_meanings(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(c,) for c in _CODES], "text string"))
    return rows.groupBy(X.code_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- identification

_HEAD = "from_hex('{}')"
_FILES = [("a.png", "89504E470D0A1A0A"), ("b.jpg", "89504E470D0A1A0A"), ("c.pdf", "504B0304"), ("d.gif", "474946383961"), ("e.webp", "524946460000000057454250"),
          ("f.wav", "524946460000000057415645"), ("g.heic", "000000186674797068656963"), ("h.mp4", "000000186674797069736F6D"), ("i.wasm", "0061736D01000000"),
          ("j.doc", "D0CF11E0A1B11AE1"), ("k.rtf", "7B5C72746631"), ("l.flac", "664C6143"), ("m.ogg", "4F676753"), ("n.mp3", "494433"), ("o.tif", "49492A00"), ("p.pdf", "255044462D312E37")]
_ANY = lambda h: f"h[1:{len(h)}] = '{h}'"
_MAIL_NAMES = "('from', 'to', 'subject', 'date', 'received', 'message-id', 'mime-version')"
_SNIFFED = f"""CASE WHEN h = '' OR h IS NULL THEN 'unknown' WHEN h[3:8] = '504E47' THEN 'png' WHEN {_ANY('FFD8FF')} THEN 'jpeg'
  WHEN h[9:16] = '66747970' AND h[17:24] IN ('68656963', '68656978', '6D696631', '61766966', '68657663') THEN 'heif'
  WHEN {_ANY('52494646')} AND h[17:24] = '57454250' THEN 'webp' WHEN {_ANY('474946383761')} OR {_ANY('474946383961')} THEN 'gif' WHEN {_ANY('49492A00')} OR {_ANY('4D4D002A')} THEN 'tiff'
  WHEN h[1:8] IN ('52494646', '52494658', '52463634', '42573634') AND h[17:24] = '57415645' THEN 'wav' WHEN {_ANY('494433')} OR h[1:4] IN ('FFFB', 'FFFA', 'FFF3', 'FFF2') THEN 'mp3'
  WHEN {_ANY('664C6143')} THEN 'flac' WHEN {_ANY('4F676753')} THEN 'ogg' WHEN h[9:16] IN ('66747970', '6D6F6F76') THEN 'video' WHEN {_ANY('0061736D')} THEN 'wasm'
  WHEN contains(h[1:2048], '255044462D') THEN 'pdf' WHEN {_ANY('D0CF11E0A1B11AE1')} THEN 'cfb' WHEN {_ANY('504B0304')} OR {_ANY('504B0506')} THEN 'zip' WHEN {_ANY('7B5C727466')} THEN 'rtf'
  WHEN regexp_matches(t, '^(\\s|<\\?[^>]*>|<!DOCTYPE[^>]*>)*<svg[\\s>/]') THEN 'svg'
  WHEN len(list_distinct(list_filter(list_transform(string_split(t, chr(10))[1:200], lambda x: lower(regexp_extract(x, '^([A-Za-z-]+):', 1))), lambda x: x IN {_MAIL_NAMES}))) >= 2 THEN 'eml'
  ELSE 'unknown' END"""


@query(f"""WITH f AS (SELECT name, hex AS h, '' AS t FROM (VALUES {', '.join(f"('{n}', '{h}')" for n, h in _FILES)}) v(name, hex)
  UNION ALL SELECT 'doc-' || doc_id || '.txt', hex(encode(substr(text, 1, 8192))), substr(text, 1, 8192) FROM documents
  UNION ALL SELECT 'mail-' || doc_id || '.eml', hex(encode('Subject: ' || substr(text, 1, 100))), CASE WHEN doc_id % 2 = 0 THEN 'From: a@b.org' || chr(10) ELSE '' END || 'Subject: ' || replace(substr(text, 1, 100), chr(10), ' ') || chr(10) FROM documents
  UNION ALL SELECT 'page-' || page_id || '.svg', hex(encode(substr(html, 1, 8192))), substr(html, 1, 8192) FROM pages
  UNION ALL SELECT 'drawn-' || page_id || '.svg', hex(encode('<?xml?> <svg>')), '<?xml?> <svg>' FROM pages),
k AS (SELECT name, {_SNIFFED} AS format, regexp_extract(lower(name), '\\.([a-z0-9]+)$', 1) AS ext FROM f),
m AS (SELECT *, CASE WHEN ext = 'jpg' THEN 'jpeg' WHEN ext IN ('heic') THEN 'heif' WHEN ext = 'tif' THEN 'tiff' WHEN ext = 'mp4' THEN 'video' WHEN ext = 'doc' THEN 'cfb'
  WHEN ext IN ('png', 'pdf', 'gif', 'webp', 'wav', 'wasm', 'rtf', 'flac', 'ogg', 'mp3', 'svg', 'eml') THEN ext END AS said FROM k)
SELECT name, format, CASE WHEN said <> format THEN said END AS misnamed FROM m""")
def sniff_format(spark, sf_dir):
    files = spark.createDataFrame([(n, bytes.fromhex(h)) for n, h in _FILES], "name string, content binary")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id", F.lit(".svg")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    head = F.replace(F.substring("text", 1, 100), F.lit("\n"), F.lit(" "))
    lines = F.concat(F.when(F.col("doc_id") % 2 == 0, "From: a@b.org\n").otherwise(""), F.lit("Subject: "), head, F.lit("\n"))
    mails = table(spark, sf_dir, "documents").select(F.concat(F.lit("mail-"), "doc_id", F.lit(".eml")).alias("name"), F.encode(lines, "UTF-8").alias("content"))
    drawn = table(spark, sf_dir, "pages").select(F.concat(F.lit("drawn-"), "page_id", F.lit(".svg")).alias("name"), F.encode(F.lit("<?xml?> <svg>"), "UTF-8").alias("content"))
    return sniff.identified(files.unionByName(docs).unionByName(mails).unionByName(pages).unionByName(drawn)).select("name", "format", "misnamed")


@query(rf"""
WITH p AS (SELECT CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a/..' WHEN 2 THEN 'c:' ELSE '..b' END || CASE page_id % 4 WHEN 0 THEN ltrim(path, '/') ELSE path END AS path
  FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages))
SELECT regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.\.([a-z0-9]+)$', 1) AS extension, count(*) AS n,
  count(*) FILTER (WHERE regexp_matches(path, '^/|\\|^[A-Za-z]:|(^|/)\.\.(/|$)')) AS rooted FROM p GROUP BY 1""")
def url_extensions(spark, sf_dir):
    """Paths of pages as members of archives: plain, through a folder above, on a drive, and with a name that only begins with dots."""
    path, n = X.lower(X.url_path(F.col("url"))), F.col("page_id") % 4
    rows = table(spark, sf_dir, "pages").select(F.when(n == 0, F.ltrim(path, F.lit("/"))).when(n == 1, F.concat(F.lit("a/.."), path)).when(n == 2, F.concat(F.lit("c:"), path)).otherwise(F.concat(F.lit("..b"), path)).alias("path"))
    return rows.groupBy(X.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("n"), F.count_if(X.unsafe_path(F.col("path"))).alias("rooted"))


# ---- facts, summaries and reports over documents


def _facts(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    long = lambda kind, a: docs.select(F.col("doc_id").alias("file_id"), F.lit(kind).alias("kind"), F.explode(a).alias("text"))
    t = F.col("text")
    return long("emails", X.emails(t, ())).unionByName(long("sentfrom", X.ipv4(t))).unionByName(long("account", X.home_accounts(t)))


def _problems(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("t"))
    made = F.array_compact(F.array(
        F.when(F.col("t").rlike(r"[*$%&#]{3}"), F.struct(F.lit("damage").alias("concern"), F.lit("runs of signs").alias("label"))),
        F.when(F.col("t").contains("!!"), F.struct(F.lit("hidden").alias("concern"), F.lit("data after a line").alias("label"))),
        F.when(F.col("t").contains("|"), F.struct(F.lit("oddity").alias("concern"), F.lit("bars").alias("label"))),
    ))
    return docs.select("file_id", F.explode(made).alias("p")).select("file_id", "p.concern", "p.label")


def _files(spark, sf_dir) -> DataFrame:
    """Documents as files: source as format, labelled ones as read in full, a null format as unknown."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), "quality")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.when(F.col("source") == "src0", "unknown").otherwise(F.col("source")).alias("format"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"),
    )
    return docs.join(labels, "file_id", "left").select(
        "file_id", "format", "bytes", F.coalesce(F.col("quality") == 1, F.lit(True)).alias("metadata_complete"), F.when(F.col("quality") == 0, F.lit("text")).alias("misnamed")
    )


_FACTS = f"""facts AS (
  SELECT doc_id AS file_id, 'emails' AS kind, unnest(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i)) AS text
  FROM (SELECT doc_id, {_mails(False)} AS a FROM documents)
  UNION ALL SELECT doc_id, 'sentfrom', unnest({_IPS}) FROM documents
  UNION ALL SELECT doc_id, 'account', unnest(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i))
  FROM (SELECT doc_id, {_accounts("coalesce(text, '')")} AS a FROM documents)
), problems AS (
  SELECT doc_id AS file_id, 'damage' AS concern, 'runs of signs' AS label FROM documents WHERE regexp_matches(text, '[*$%&#]{{3}}')
  UNION ALL SELECT doc_id, 'hidden', 'data after a line' FROM documents WHERE contains(text, '!!')
  UNION ALL SELECT doc_id, 'oddity', 'bars' FROM documents WHERE contains(text, '|')
), files AS (
  SELECT doc_id AS file_id, CASE WHEN source = 'src0' THEN 'unknown' ELSE source END AS format, strlen(coalesce(text, '')) AS bytes,
    coalesce(quality = 1, true) AS metadata_complete, CASE WHEN quality = 0 THEN 'text' END AS misnamed
  FROM documents LEFT JOIN labels USING (doc_id)
), f AS (SELECT file_id, list_sort(list(DISTINCT kind)) AS kinds, count(*) AS n_facts FROM facts GROUP BY 1),
p AS (SELECT file_id, list_sort(list(DISTINCT concern)) AS concerns, count(*) AS n_problems, bool_or(concern IN ('damage', 'hidden')) AS unread FROM problems GROUP BY 1),
summary AS (
  SELECT file_id, format, misnamed, bytes, coalesce(kinds, []) AS kinds, coalesce(concerns, []) AS concerns, coalesce(n_facts, 0) AS n_facts, coalesce(n_problems, 0) AS n_problems,
    metadata_complete AND NOT coalesce(unread, false) AS complete,
    CASE WHEN format = 'unknown' THEN 'unsupported' WHEN metadata_complete AND NOT coalesce(unread, false) THEN 'complete' ELSE 'partial' END AS status
  FROM files LEFT JOIN f USING (file_id) LEFT JOIN p USING (file_id)
), tags AS (
  SELECT *, list_sort(list_distinct(list_concat(list_concat(list_concat(list_concat(CASE WHEN misnamed IS NOT NULL THEN ['misnamed'] ELSE [] END, concerns),
    CASE WHEN n_facts > 0 THEN ['reveals'] ELSE [] END), CASE WHEN NOT complete THEN ['incomplete'] ELSE [] END), kinds))) AS tags FROM summary
)"""


def _summary(spark, sf_dir) -> DataFrame:
    files = _files(spark, sf_dir)
    return reports.summaries(files.drop("bytes"), _facts(spark, sf_dir), _problems(spark, sf_dir)).join(files.select("file_id", "bytes"), "file_id")


@query(f"WITH {_FACTS} SELECT * FROM facts")
def facts_long(spark, sf_dir):
    return _facts(spark, sf_dir)


@query(f"""WITH {_FACTS} SELECT file_id, format, misnamed, array_to_string(kinds, ',') AS kinds, array_to_string(concerns, ',') AS concerns, n_facts, n_problems, complete, status FROM summary""")
def summaries(spark, sf_dir):
    s = _summary(spark, sf_dir).drop("bytes")
    return s.withColumns({"kinds": F.array_join("kinds", ","), "concerns": F.array_join("concerns", ",")})


@query(f"""WITH {_FACTS} SELECT file_id, array_to_string(tags, ',') AS tags, list_has_any(tags, ['reveals', 'hidden', 'damage', 'incomplete']) AS fails FROM tags""")
def tags_fail_on(spark, sf_dir):
    return reports.failing(reports.tagged(_summary(spark, sf_dir))).select("file_id", F.array_join("tags", ",").alias("tags"), "fails")


@query(f"WITH {_FACTS} SELECT file_id FROM summary WHERE format <> 'unknown' AND complete AND n_problems = 0 AND n_facts = 0 AND misnamed IS NULL")
def quiet_rows(spark, sf_dir):
    return reports.quiet(_summary(spark, sf_dir)).select("file_id")


_COVERAGE = """count(*) AS files, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'partial') AS partial,
  count(*) FILTER (WHERE status = 'unsupported') AS unsupported, sum(bytes)::BIGINT AS bytes FROM summary"""


@query(f"WITH {_FACTS} SELECT format, {_COVERAGE} GROUP BY format")
def coverage_by_format(spark, sf_dir):
    return reports.coverage(_summary(spark, sf_dir))


@query(f"WITH {_FACTS} SELECT CASE WHEN grouping(format) = 1 THEN '*' ELSE format END AS format, {_COVERAGE} GROUP BY ROLLUP (format)")
def coverage_rollup(spark, sf_dir):
    return reports.coverage_with_total(_summary(spark, sf_dir))


@query(f"""WITH {_FACTS} SELECT count(*) AS files, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'partial') AS partial,
  count(*) FILTER (WHERE status = 'unsupported') AS unsupported, count(*) FILTER (WHERE n_facts > 0) AS reveals, count(*) FILTER (WHERE n_problems > 0) AS with_problems,
  count(*) FILTER (WHERE list_contains(concerns, 'damage')) AS damage, count(*) FILTER (WHERE list_contains(concerns, 'hidden')) AS hidden,
  count(*) FILTER (WHERE list_contains(concerns, 'oddity')) AS oddity, count(misnamed) AS misnamed, sum(n_facts)::BIGINT AS facts, sum(n_problems)::BIGINT AS problems FROM tags""")
def batch_summary(spark, sf_dir):
    return reports.batch_summary(_summary(spark, sf_dir))


@query(f"WITH {_FACTS} SELECT lang AS extension, count(*) AS files FROM summary JOIN documents ON doc_id = file_id WHERE status = 'unsupported' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def unread_top5(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang")
    return reports.top_unread(_summary(spark, sf_dir).join(langs, "file_id"), F.col("lang"))


_KINDS = f"kinds AS (SELECT unnest({KINDS!r}) AS kind, generate_subscripts({KINDS!r}, 1) AS position)"


@query(f"WITH {_FACTS}, {_KINDS} SELECT file_id, string_agg(kind, ', ' ORDER BY position) AS categories FROM (SELECT DISTINCT file_id, kind FROM facts) JOIN kinds USING (kind) GROUP BY file_id")
def category_listing(spark, sf_dir):
    return reports.category_list(_facts(spark, sf_dir), finding_kinds(spark))


@query(f"""WITH {_FACTS} SELECT file_id, CASE WHEN list_contains(kinds, 'emails') THEN 'emails' ELSE '' END AS blocked,
  CASE WHEN list_contains(kinds, 'emails') THEN 'blocked' WHEN status <> 'complete' THEN 'unchecked' ELSE 'passed' END AS result FROM summary""")
def policy_result(spark, sf_dir):
    got = reports.policy_result(_summary(spark, sf_dir), finding_kinds(spark), ["emails", "account"], True)
    return got.select("file_id", F.array_join("blocked", ",").alias("blocked"), "result")


@query(f"""WITH {_FACTS} SELECT DISTINCT file_id, 'text' AS format, kind FROM facts JOIN summary s USING (file_id)
  WHERE s.complete AND trim(facts.text) <> '' AND kind IN ('account', 'emails', 'addresses')""")
def planned_removals(spark, sf_dir):
    files = _summary(spark, sf_dir).select("file_id", F.lit("text").alias("format"), "complete")
    return reports.planned_removals(_facts(spark, sf_dir), files, removal_contract(spark))


@query("""SELECT conv_id, role, count(DISTINCT text) AS n_values, count(text) AS n, md5(array_to_string(list_sort(list(DISTINCT text))[1:20], '|')) AS values_md5
FROM conversations GROUP BY 1, 2 HAVING count(DISTINCT text) > 1""")
def differing_fields(spark, sf_dir):
    got = reports.differing_fields(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "text")
    return got.select("conv_id", "role", "n_values", "n", F.md5(F.encode(F.array_join("values", "|"), "UTF-8")).alias("values_md5"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS hop FROM conversations")
def mail_hops(spark, sf_dir):
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("hop"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(s, '[",' || chr(13) || chr(10) || ']') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS cell
FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '^[\t\r ]*[=+\-@]') THEN '''' || text ELSE text END AS s FROM (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '=' || text ELSE text END AS text FROM documents))""")
def csv_guard(spark, sf_dir):
    t = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("="), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.csv_cell(t).alias("cell"))


@query("SELECT doc_id, strlen(coalesce(text, '')) AS bytes, sha256(coalesce(text, '')) AS sha256, md5(coalesce(text, '')) AS md5 FROM documents")
def sha256_receipts(spark, sf_dir):
    b = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(b).cast("long").alias("bytes"), F.sha2(b, 256).alias("sha256"), F.md5(b).alias("md5"))


@query(f"""WITH {_FACTS}, r AS (SELECT file_id, '[' || string_agg('{{"kind":"' || kind || '","text":"' || text || '"}}', ',' ORDER BY kind, text) || ']' AS reveals FROM facts GROUP BY 1),
q AS (SELECT file_id, list_transform(concerns, lambda c: '"' || c || '"') AS c FROM summary)
SELECT file_id, '{{"file":' || file_id || coalesce(',"format":"' || format || '"', '') || ',"problems":[' || array_to_string(c, ',') || ']' || coalesce(',"reveals":' || reveals, '') || coalesce(',"misnamed":"' || misnamed || '"', '') ||
  CASE WHEN complete THEN '' ELSE ',"complete":false' END || '}}' AS line FROM summary LEFT JOIN r USING (file_id) JOIN q USING (file_id)""")
def report_ndjson(spark, sf_dir):
    return reports.ndjson(_summary(spark, sf_dir), _facts(spark, sf_dir))


# ---- comparisons


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings of documents by source, and of a copy: some e-mails are gone, some masked, some there twice, all addresses are gone."""
    from pyspark.sql import Window as W

    src = table(spark, sf_dir, "documents").select("doc_id", "source")
    facts = _facts(spark, sf_dir).join(src, F.col("file_id") == F.col("doc_id"))
    order = F.col("doc_id") * 1_000_000 + F.row_number().over(W.partitionBy("doc_id").orderBy("kind", "text"))
    all_ = facts.select(F.coalesce("source", F.lit("none")).alias("file_id"), order.alias("ordinal"), "kind", F.lit("file").alias("scope"), F.col("text").alias("value"), "doc_id")
    kept = all_.where("kind = 'emails' and doc_id % 3 <> 0")
    copy = kept.withColumn("value", F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("x"), "value")).otherwise(F.col("value")))
    twice = all_.where("kind = 'emails' and doc_id % 3 = 0 and doc_id % 2 = 0").withColumn("ordinal", -F.col("ordinal")).withColumn("kind", F.lit("account"))
    snaps = src.select(F.coalesce("source", F.lit("none")).alias("file_id")).distinct().select(
        "file_id", F.lit("text").alias("source_format"), F.lit("text").alias("copy_format"), F.lit(True).alias("source_complete"), F.lit(True).alias("copy_complete")
    )
    return all_.drop("doc_id"), copy.unionByName(twice).drop("doc_id"), snaps


#: By file, kind and value: how often it stands on either side; from the counts alone follows what becomes of each finding.
_COMPARED = f"""WITH {_FACTS}, s AS (SELECT doc_id, coalesce(source, 'none') AS file_id, kind, facts.text AS v FROM facts JOIN documents d ON d.doc_id = facts.file_id),
c AS (SELECT file_id, kind, CASE WHEN doc_id % 3 = 2 THEN 'x' || v ELSE v END AS v FROM s WHERE kind = 'emails' AND doc_id % 3 <> 0
  UNION ALL SELECT file_id, 'account', v FROM s WHERE kind = 'emails' AND doc_id % 6 = 0),
n AS (SELECT file_id, kind, v, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM (SELECT file_id, kind, v, 1 AS a, 0 AS b FROM s UNION ALL SELECT file_id, kind, v, 0, 1 FROM c) GROUP BY 1, 2, 3),
k AS (SELECT file_id, kind, sum(least(a, b))::BIGINT AS same, sum(a - least(a, b))::BIGINT AS a, sum(b - least(a, b))::BIGINT AS b FROM n GROUP BY 1, 2),
counted AS (SELECT file_id, kind, same, least(a, b) AS changed, a - least(a, b) AS gone, b - least(a, b) AS extra FROM k),
items AS (SELECT file_id, kind, 'present' AS status, 'still_present' AS reason, false AS unexpected, unnest(range(same)) AS i FROM counted
  UNION ALL SELECT file_id, kind, 'present', 'value_changed_same_kind', false, unnest(range(changed)) FROM counted
  UNION ALL SELECT file_id, kind, CASE WHEN kind IN ('account', 'emails', 'addresses') THEN 'removed' ELSE 'unchecked' END,
    CASE WHEN kind IN ('account', 'emails', 'addresses') THEN 'removed' ELSE 'coverage_incomplete' END, false, unnest(range(gone)) FROM counted
  UNION ALL SELECT file_id, kind, 'present', 'unexpected_output', true, unnest(range(extra)) FROM counted
  UNION ALL SELECT DISTINCT coalesce(source, 'none'), 'file', 'unchecked', 'no_comparable_findings', false, 0 FROM documents WHERE coalesce(source, 'none') NOT IN (SELECT file_id FROM n))"""


@query(f"{_COMPARED} SELECT file_id, kind, status, reason, unexpected FROM items")
def verify_compare(spark, sf_dir):
    return verify.compare_copies(*_snapshots(spark, sf_dir), removal_contract(spark))


@query(f"""{_COMPARED} SELECT kind, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'present') AS present,
  count(*) FILTER (WHERE status = 'unchecked') AS unchecked, count(*) FILTER (WHERE unexpected) AS unexpected FROM items GROUP BY kind""")
def verify_totals(spark, sf_dir):
    return verify.comparison_totals(verify_compare(spark, sf_dir))


CUT = "1995-06-17"


@query(f"""SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change
FROM (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1) a
FULL JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE NOT o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1) b ON a.k = b.k""")
def structural_diff(spark, sf_dir):
    """Customers before and from a day on: gone, new, or with another highest priority."""
    o = table(spark, sf_dir, "orders").withColumn("early", F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"))
    side = lambda x: o.where(x).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("v"))
    return verify.structural_diff(side(F.col("early")), side(~F.col("early")), ["o_custkey"], "v")


@query(f"""WITH a AS (SELECT l_suppkey, l_returnflag AS kind, list_sort(list(l_linenumber)) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}' GROUP BY 1, 2),
b AS (SELECT l_suppkey, l_returnflag AS kind, list_sort(list(l_linenumber)) AS v FROM lineitem WHERE NOT l_shipdate < TIMESTAMP '{CUT}' GROUP BY 1, 2)
SELECT l_suppkey, kind, CASE WHEN b.v IS NULL THEN 'only_a' WHEN a.v IS NULL THEN 'only_b' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (l_suppkey, kind)""")
def semantic_diff(spark, sf_dir):
    """Return flags of each supplier before and from a day on, with their line numbers as values."""
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("kind"), "l_linenumber", (F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")).alias("early"))
    return verify.semantic_diff(r.where("early"), r.where("not early"), "l_suppkey", "kind", "l_linenumber")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS site, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_id) AS n FROM p)
SELECT page_id, path, CASE WHEN n = 1 THEN path ELSE path || '#' || n END AS unique_path FROM n""")
def path_numbering(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", X.url_path(F.col("url")).alias("path"))
    return verify.numbered_paths(p, [], "path", "page_id")


@query(r"""WITH p AS (SELECT string_split(ltrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), '/')[1] AS folder, strlen(html) AS bytes FROM pages)
SELECT folder, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM p GROUP BY folder""")
def folder_totals(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        F.substring_index(F.ltrim(X.url_path(F.col("url")), F.lit("/")), "/", 1).alias("folder"), F.octet_length("html").cast("long").alias("bytes")
    )
    return p.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'the')")
def archive_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.contains(X.lower(F.col("url")), F.lit("the"))).select("page_id", "url")


# ---- relations


@query("SELECT md5(coalesce(text, '')) AS serial, array_to_string(list_sort(list(doc_id)), ',') AS indexes FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_serials(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("serial"), F.col("doc_id").alias("index"))
    return relate.repeated_serials(s).select("serial", F.array_join(F.transform("indexes", lambda x: x.cast("string")), ",").alias("indexes"))


@query("SELECT doc_id AS index, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS n FROM documents) WHERE n > 1")
def related_ids(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("serial"), F.col("doc_id").alias("index"))
    return relate.serial_members(s).select("index", "n")


def _points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("index"), *[(F.get("embedding", F.lit(i)).cast("double") * 1000).alias(c) for i, c in enumerate("xyz")])


@query("""WITH p AS (SELECT vec_id AS i, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 1000 AS z FROM embeddings)
SELECT a.i AS a, b.i AS b, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 6) AS distance
FROM p a JOIN p b ON a.i < b.i AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 30""")
def grid_neighbours(spark, sf_dir):
    return relate.near_pairs(_points(spark, sf_dir), 30.0).withColumn("distance", F.round("distance", 6))


@query(r"""WITH d AS (SELECT user_id, event_id, ts FROM events WHERE event_id % 3 <> 2)
SELECT user_id, true AS zoned, array_to_string(list(event_id ORDER BY date_trunc('second', ts), event_id), ',') AS indexes FROM d WHERE event_id % 3 = 0 GROUP BY user_id
UNION ALL SELECT user_id, false, array_to_string(list(event_id ORDER BY date_trunc('second', ts), event_id), ',') FROM d WHERE event_id % 3 = 1 GROUP BY user_id""")
def date_orders(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    taken = F.when(F.col("event_id") % 3 == 0, F.concat(stamp, F.lit("Z"))).when(F.col("event_id") % 3 == 1, stamp).otherwise("2024:02:31 10:00:00")
    got = relate.date_orders(e.withColumn("taken", taken), ["user_id"], "event_id", "taken")
    return got.withColumn("indexes", F.array_join(F.transform("indexes", lambda x: x.cast("string")), ","))


# ---- ranges and bytes

_RANGES = """r AS (SELECT user_id AS file_id, event_id AS node_id, event_id % 5 AS depth, epoch(date_trunc('second', ts))::BIGINT - 1704067200 AS start,
  epoch(date_trunc('second', ts))::BIGINT - 1704067200 + 600 * (1 + event_id % 7) AS end_, event_type AS role FROM events)"""


def _ranges(spark, sf_dir) -> DataFrame:
    s = F.unix_timestamp("ts") - 1704067200
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("node_id"), (F.col("event_id") % 5).alias("depth"), s.alias("start"),
        (s + 600 * (1 + F.col("event_id") % 7)).alias("end"), F.col("event_type").alias("role"),
    )


@query(f"""WITH {_RANGES}, cuts AS (SELECT DISTINCT file_id, unnest([0, start, end_]) AS pos FROM r),
steps AS (SELECT * FROM (SELECT file_id, pos, lead(pos) OVER (PARTITION BY file_id ORDER BY pos) AS till FROM cuts) WHERE till IS NOT NULL),
named AS (SELECT s.file_id, pos, till, coalesce(arg_max(role, (depth, node_id)), 'hidden') AS role FROM steps s LEFT JOIN r ON r.file_id = s.file_id AND start <= pos AND end_ >= till GROUP BY 1, 2, 3),
marked AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY file_id ORDER BY pos) = role THEN 0 ELSE 1 END AS new FROM named),
islands AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY pos) AS island FROM marked)
SELECT file_id, min(pos) AS start, max(till) AS "end", any_value(role) AS role FROM islands GROUP BY file_id, island""")
def composition_sweep(spark, sf_dir):
    return ranges.composition(_ranges(spark, sf_dir)).drop("node_id")


@query(f"""WITH {_RANGES}, m AS (SELECT *, max(end_) OVER (PARTITION BY file_id ORDER BY start, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT file_id, node_id, start, end_ AS "end", CASE WHEN start > before THEN start - before END AS gap, coalesce(start < before, false) AS overlaps FROM m""")
def range_gaps_overlaps(spark, sf_dir):
    return ranges.gaps_and_overlaps(_ranges(spark, sf_dir), "file_id", "start", "end", "node_id")


def _contents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


_BYTES = """b AS (SELECT doc_id::VARCHAR AS file_id, unnest(range(0, strlen(text))) AS pos, greatest(least(8, strlen(text) // 256), 1) AS bins, strlen(text) AS size,
  hex(encode(text)) AS h FROM documents WHERE text <> ''), v AS (SELECT file_id, pos // ceil(size / bins)::BIGINT AS "window", ('0x' || h[2*pos+1:2*pos+2])::INTEGER AS byte FROM b)"""


@query(f"""WITH {_BYTES}, c AS (SELECT file_id, "window", byte, count(*) AS n FROM v GROUP BY ALL)
SELECT file_id, "window", sum(n)::BIGINT AS bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS entropy FROM c GROUP BY 1, 2""")
def entropy_windows(spark, sf_dir):
    return ranges.entropy_windows(_contents(spark, sf_dir))


@query(f"WITH {_BYTES} SELECT byte::BIGINT AS byte, count(*) AS n FROM v GROUP BY byte")
def byte_histogram(spark, sf_dir):
    return ranges.byte_histogram(_contents(spark, sf_dir))


@query("SELECT role, sum(strlen(text))::BIGINT AS bytes, count(*) AS n FROM conversations GROUP BY role")
def role_totals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n"))


_FOUND = """WITH t AS (SELECT doc_id::VARCHAR AS file_id, hex(encode(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS h FROM documents),
p AS (SELECT file_id, h, unnest(range(0, strlen(h) // 2)) AS pos FROM t) SELECT file_id, pos AS "at" FROM p WHERE h[2 * pos + 1:2 * pos + {n}] = '{hex}'"""


@query(_FOUND.format(n=8, hex="74687468"))
def byte_search_overlapping(spark, sf_dir):
    return ranges.occurrences(_contents(spark, sf_dir), "THth")


@query("""WITH t AS (SELECT doc_id::VARCHAR AS file_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT file_id, h, unnest(range(0, strlen(h) // 2)) AS pos FROM t)
SELECT file_id, pos AS "at" FROM p WHERE h[2 * pos + 1:2 * pos + 4] = '2E0A' UNION ALL SELECT file_id, 1000 FROM t WHERE strlen(h) // 2 > 1000""")
def byte_search_hex(spark, sf_dir):
    """Where the bytes ``2E 0A`` stand, and which texts reach offset 1000."""
    c = _contents(spark, sf_dir)
    return ranges.occurrences(c, "2E 0A").unionByName(ranges.occurrences(c, "@0x3E8"))


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.9) AS p90, quantile_disc(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY 1")
def percentile_nearest_rank(spark, sf_dir):
    return ranges.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", [0.5, 0.9, 0.99])


@query("""WITH m AS (SELECT l_shipdate::DATE - DATE '1992-01-01' AS d, l_returnflag, l_extendedprice AS v FROM lineitem), s AS (SELECT l_returnflag, median(v) AS md, stddev_pop(v) / avg(v) AS cv FROM m GROUP BY 1)
SELECT l_returnflag, any_value(md) AS median, round(any_value(cv), 6) AS cv, round(median(abs(v - md)), 6) AS mad FROM m JOIN s USING (l_returnflag) GROUP BY 1""")
def median_mad_cv(spark, sf_dir):
    return ranges.spread(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").withColumns({"cv": F.round("cv", 6), "mad": F.round("mad", 6)})


# ---- counters


@query("""SELECT strftime(ts, '%Y-%m-%d') AS period, 'day' AS metric, '' AS value, count(DISTINCT user_id) AS n FROM events GROUP BY 1
UNION ALL SELECT strftime(ts, '%Y-%m'), 'month', '', count(DISTINCT user_id) FROM events GROUP BY 1
UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'new', '', count(*) FROM (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1) GROUP BY 1
UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'type', event_type, count(*) FROM events GROUP BY 1, 3""")
def visit_counts(spark, sf_dir):
    return counters.visit_counts(table(spark, sf_dir, "events"))


@query("SELECT period, metric, value, sum(n)::BIGINT AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS period, 'type' AS metric, event_type AS value, 1 AS n FROM events) GROUP BY ALL")
def upserted_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = lambda x: counters.visit_counts(x).where("metric = 'type'")
    return counters.merged_counts(rows(e.where("event_id % 2 = 0")), rows(e.where("event_id % 2 = 1")))


@query("SELECT event_id, ts::DATE::VARCHAR AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS rn FROM events QUALIFY rn <= 300")
def daily_cap(spark, sf_dir):
    return counters.daily_cap(table(spark, sf_dir, "events"), "ts", ["event_id"]).select("event_id", F.col("day").cast("string"), "rn")


@query("""WITH n AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT unnest(generate_series(max(day) - 29, max(day), INTERVAL 1 DAY))::DATE AS day FROM n)
SELECT day::VARCHAR AS day, coalesce(n, 0) AS n, floor(8 * coalesce(n, 0) / greatest(max(coalesce(n, 0)) OVER (), 1) + 0.5)::INTEGER AS level FROM s LEFT JOIN n USING (day)""")
def sparkline_30d(spark, sf_dir):
    return counters.sparkline(table(spark, sf_dir, "events"), "ts").withColumn("day", F.col("day").cast("string"))


@query("SELECT event_type, sum(value) AS total FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top5_by_sum(spark, sf_dir):
    return counters.top_by_sum(table(spark, sf_dir, "events"), "event_type", "value")


# ---- decoders, copies, streams


def _fixtures() -> list[tuple[str, bytes]]:
    """Small files of many formats, made from bytes here."""
    from gleanery.sources.samples import SAMPLES

    return [(name, make()) for name, make in SAMPLES.items()]


def _sample_files(spark) -> DataFrame:
    rows = [(n, n, bytearray(b)) for n, b in _fixtures()]
    return spark.createDataFrame(rows, "file_id string, name string, content binary")


_NONE = "NULL::BIGINT AS start, NULL::BIGINT AS length, NULL::BOOLEAN AS complete"


@query(f"""SELECT * FROM {values(INSPECTED, 'tttntt' + 'nnb')} v(file_id, format, row, ordinal, kind, text, start, length, complete)
UNION ALL SELECT 'page-' || page_id, 'unknown', 'file', 0, 'unknown', NULL, 0, strlen(html), true FROM pages
UNION ALL SELECT 'doc-' || doc_id, 'unknown', 'file', 0, 'unknown', NULL, 0, strlen(coalesce(text, '')), true FROM documents
UNION ALL SELECT 'item-' || item_id, 'unknown', 'file', 0, 'unknown', NULL, 0, strlen(text), true FROM benchmark
UNION ALL SELECT file_id, 'unknown', 'fact', row_number() OVER (PARTITION BY file_id ORDER BY kind) - 1, kind, text, NULL, NULL, NULL FROM (
  SELECT 'doc-' || doc_id AS file_id, 'emails' AS kind, listed AS text FROM ({_mail_sql(True)}) UNION ALL SELECT 'page-' || doc_id, 'emails', listed FROM ({_mail_sql(True, '(SELECT page_id AS doc_id, html AS text FROM pages)')})
  UNION ALL SELECT id, 'account', array_to_string(a, ', ') FROM (SELECT 'doc-' || doc_id AS id, {_accounts("coalesce(text, '')")} AS a FROM documents) WHERE len(a) > 0)""")
def inspect_files(spark, sf_dir):
    """Every fact and problem of the sample files and of all pages, documents and benchmark items as files."""
    from gleanery.sources.engine import inspect
    from gleanery.sources.files import from_table

    files = _sample_files(spark)
    for name, kind, ident, body in (("pages", "page", "page_id", "html"), ("documents", "doc", "doc_id", "text"), ("benchmark", "item", "item_id", "text")):
        named = table(spark, sf_dir, name).withColumn("id", F.concat(F.lit(f"{kind}-"), ident))
        files = files.unionByName(from_table(named, "id", body).drop("length"))
    rows = inspect(files)
    return rows.where("row <> 'node'").select("file_id", "format", "row", "ordinal", "kind", "text", "start", "length", "complete")


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '<#comment>', 'g'), '(?is)(<(script|style)\\b[^>]*>).*?</(script|style)>', '\\1', 'g'), '<([a-zA-Z#][a-zA-Z0-9]*)', 1)) AS label FROM pages)
SELECT lower(label) AS label, count(*) AS n FROM t GROUP BY 1""")
def html_node_tree(spark, sf_dir):
    from gleanery.sources.engine import inspect, tables
    from gleanery.sources.files import from_table

    pages = from_table(table(spark, sf_dir, "pages"), "page_id", "html").withColumn("format", F.lit("html"))
    nodes = tables(inspect(pages, "format"))["nodes"].where("parent_id is not null")
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query()
def node_depths(spark, sf_dir):
    """Depth of every node of the pages' trees, each walked once (a recursive query reads all nodes again for each level)."""
    from gleanery.operators.roles import with_depth
    from gleanery.sources.engine import inspect, tables
    from gleanery.sources.files import from_table

    pages = from_table(table(spark, sf_dir, "pages"), "page_id", "html").withColumn("format", F.lit("html"))
    nodes = tables(inspect(pages, "format"))["nodes"].select("file_id", "node_id", "parent_id")
    return with_depth(nodes, []).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT * FROM {values(RECEIPTS, 'ttnttntb')} v(file_id, format, removed_bytes, removed_kinds, present_kinds, unchecked, error, complete)
UNION ALL SELECT 'page-' || page_id, 'unknown', 0, '', '', 0, 'unsupported', false FROM pages""")
def clean_receipts(spark, sf_dir):
    """Clean copies of the sample files and of all pages as files, read again and compared with what they are copies of."""
    from gleanery.sources.files import from_table
    from gleanery.sources.rewrite import verified_copies

    pages = table(spark, sf_dir, "pages").withColumn("id", F.concat(F.lit("page-"), "page_id"))
    _, receipts = verified_copies(_sample_files(spark).unionByName(from_table(pages, "id", "html").drop("length")))
    listed = lambda c: F.array_join(c, ",").alias(c)
    return receipts.select("file_id", "format", "removed_bytes", listed("removed_kinds"), listed("present_kinds"), "unchecked", "error", "complete")


@query(f"SELECT * FROM {values(MEMBERS, 'ttnnnn')} v(file_id, name, position, method, size, crc)")
def archive_listing(spark, sf_dir):
    """Members of the archives among the sample files, by a table function under SQL."""
    from gleanery.sources.engine import register

    register(spark)
    rows = sniff.identified(_sample_files(spark)).where("format = 'zip'")
    return spark.sql("SELECT file_id, e.name, e.position, CAST(e.method AS BIGINT) AS method, e.size, e.crc FROM {rows}, LATERAL archive_entries(content) e", rows=rows)


@query(f"SELECT * FROM {values(CARVED, 'ttnn')} v(file_id, format, start, length) UNION ALL SELECT 'doc-' || doc_id, 'png', 3 + strlen(coalesce(text, '')), 68 FROM documents")
def carved_files(spark, sf_dir):
    """Files inside the sample files, and in all documents, to each of which a picture is put."""
    from gleanery.sources.engine import carved
    from gleanery.sources.samples import png

    body = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(b"..."), F.lit(png()), F.lit(b"..."))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("file_id"), body.alias("content"))
    return carved(_sample_files(spark).select("file_id", "content").unionByName(docs))


@query("SELECT CAST(ts::DATE AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_type_counts(spark, sf_dir):
    from gleanery.streaming.counters import type_counts

    return type_counts(table(spark, sf_dir, "events"))


@query("SELECT CAST(ts::DATE AS TIMESTAMP) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def stream_daily_people(spark, sf_dir):
    from gleanery.streaming.counters import daily_people

    return daily_people(table(spark, sf_dir, "events"))


@query("""WITH RECURSIVE p AS (SELECT vec_id AS i, row_number() OVER (ORDER BY vec_id) AS k, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 1000 AS z FROM embeddings),
near AS MATERIALIZED (SELECT b.k, list(a.i ORDER BY a.i) AS before FROM p a JOIN p b ON a.k < b.k AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 30 GROUP BY 1),
walk(k, firsts, i, first) AS (SELECT 1::BIGINT, [i], i, i FROM p WHERE k = 1
  UNION ALL SELECT p.k, CASE WHEN list_has_any(coalesce(n.before, []), firsts) THEN firsts ELSE list_append(firsts, p.i) END, p.i,
    coalesce(list_min(list_intersect(coalesce(n.before, []), firsts)), p.i) FROM walk w JOIN p ON p.k = w.k + 1 LEFT JOIN near n ON n.k = p.k)
SELECT i AS index, first FROM walk""")
def greedy_clusters(spark, sf_dir):
    from gleanery.operators.relate import greedy_clusters as clusters

    return clusters(_points(spark, sf_dir), 30.0)


# ---- pages as boxes, made from events: one page a user, glyphs and fills by event


def _boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.lit("f").alias("file_id"), F.col("user_id").alias("page"), F.col("event_id").alias("ordinal"))
    x, y = (F.col("ordinal") * 37 % 400).cast("double"), (F.col("ordinal") * 53 % 300).cast("double")
    glyphs = e.where("ordinal % 3 <> 0").select(*e.columns, x.alias("l"), y.alias("b"), (x + 8).alias("r"), (y + 10).alias("t"), (F.col("ordinal") % 2 == 0).alias("dark"), (x > 390).alias("off_page"))
    fills = e.where("ordinal % 3 = 0").select(
        *e.columns, x.alias("l"), y.alias("b"), (x + 60).alias("r"), (y + 40).alias("t"), (F.col("ordinal") % 4 / 4).alias("lightness"), (1 - F.col("ordinal") % 5 / 10).alias("alpha")
    )
    return glyphs, fills


_BOXES = """e AS (SELECT user_id AS page, event_id AS ordinal, (event_id * 37 % 400)::DOUBLE AS l, (event_id * 53 % 300)::DOUBLE AS b FROM events),
g AS (SELECT *, l + 8 AS r, b + 10 AS t, ordinal % 2 = 0 AS dark, l > 390 AS off_page FROM e WHERE ordinal % 3 <> 0),
f AS (SELECT *, l + 60 AS r, b + 40 AS t, ordinal % 4 / 4 AS lightness, 1 - ordinal % 5 / 10 AS alpha FROM e WHERE ordinal % 3 = 0),
met AS (SELECT g.page, g.ordinal AS go, g.dark AS gdark, f.ordinal AS fo, f.lightness <= 0.25 AS fdark, f.alpha >= 0.9 AS opaque FROM g JOIN f ON g.page = f.page
  AND greatest(least(g.r, f.r) - greatest(g.l, f.l), 0) * greatest(least(g.t, f.t) - greatest(g.b, f.b), 0) >= 0.5 * 80)"""


@query(f"""WITH {_BOXES}, last AS (SELECT page, go, any_value(gdark) AS gdark, arg_max(fdark, fo) AS on_dark FROM met WHERE opaque AND fo < go GROUP BY 1, 2)
SELECT page, go AS ordinal FROM met WHERE opaque AND fdark AND fo > go UNION SELECT page, go FROM last WHERE on_dark AND gdark""")
def covered_glyphs(spark, sf_dir):
    from gleanery.operators.geometry import covered_glyphs as covered

    return covered(*_boxes(spark, sf_dir)).drop("file_id")


@query(f"WITH {_BOXES} SELECT DISTINCT page, go AS ordinal FROM met")
def marked_glyphs(spark, sf_dir):
    from gleanery.operators.geometry import marked_glyphs as marked

    return marked(*_boxes(spark, sf_dir)).drop("file_id")


@query(f"""WITH {_BOXES}, n AS (SELECT *, CASE WHEN lag(b) OVER w IS NULL OR abs(b - lag(b) OVER w) > 0.01 OR l - lag(r) OVER w > 2 THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY page ORDER BY ordinal)),
s AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY ordinal) AS word FROM n)
SELECT page, word::BIGINT AS word, count(*) AS n FROM s GROUP BY 1, 2 HAVING bool_and(off_page)""")
def hidden_words(spark, sf_dir):
    from gleanery.operators.geometry import hidden_not_cut

    return hidden_not_cut(_boxes(spark, sf_dir)[0]).drop("file_id")


@query("""SELECT l_orderkey AS file_id, l_suppkey AS number, max(l_linenumber) AS position FROM lineitem GROUP BY 1, 2""")
def latest_object_versions(spark, sf_dir):
    from gleanery.operators.geometry import latest_versions

    return latest_versions(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("number"), F.col("l_linenumber").alias("position")))


@query("""SELECT user_id AS stream, event_id AS id, event_id AS pos, max(CASE WHEN event_id % 10 = 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS checkpoint FROM events""")
def checkpoint_lookup(spark, sf_dir):
    from gleanery.operators.geometry import last_checkpoint

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"), F.col("event_id").alias("id"))
    return last_checkpoint(e, e.where("pos % 10 = 0").select("stream", "pos"))


@query("""SELECT p_partkey, p_type, CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE '%STEEL' THEN 'steel' WHEN p_type LIKE '%A%' THEN 'a' END AS doc FROM part""")
def label_match(spark, sf_dir):
    from gleanery.operators.geometry import first_label_match

    patterns = spark.createDataFrame([(0, "STANDARD*", "standard"), (1, "*STEEL", "steel"), (2, "*A*", "a")], "position int, pattern string, doc string")
    return first_label_match(table(spark, sf_dir, "part").select("p_partkey", "p_type"), patterns, "p_type").select("p_partkey", "p_type", "doc")


@query("SELECT s_suppkey, s_acctbal::VARCHAR::DECIMAL(30, 12)::DECIMAL(30, 1)::VARCHAR AS shown FROM supplier")
def fixed_numbers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.fixed(F.col("s_acctbal"), 1).alias("shown"))


@query("""WITH n AS (SELECT doc_id, strlen(coalesce(text, '')) * 37 AS n FROM documents), s AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 ELSE 2 END AS k, n / CASE WHEN n < 1024 THEN 1.0 WHEN n < 1048576 THEN 1024.0 ELSE 1048576.0 END AS x FROM n)
SELECT doc_id, CASE WHEN k = 0 OR x >= 10 THEN floor(x)::BIGINT::VARCHAR ELSE printf('%.1f', floor(x * 10) / 10) END || ' ' || ['B', 'KB', 'MB'][k + 1] AS shown FROM s""")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.human_size(F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * 37).alias("shown"))


@query("SELECT page_id, lower(regexp_extract(html, '(?i)<html\\s+lang\\s*=\\s*\"([^\"]*)\"', 1)) AS lang FROM pages")
def tag_attributes(spark, sf_dir):
    tag = F.regexp_extract("html", "(?i)(<html[^>]*>)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.lower(X.attribute(tag, "lang")), F.lit("")).alias("lang"))


@query(f"""SELECT host, count(*) AS n, host AS shown FROM (SELECT lower({_HOST.format('url')}) AS host FROM pages) GROUP BY 1
UNION ALL SELECT 'xn--exmple-bank-zij.com', 1, '{b'xn--exmple-bank-zij'[4:].decode('punycode')}.com'""")
def shown_hosts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(X.host(F.col("url")).alias("host")).unionByName(spark.createDataFrame([("xn--exmple-bank-zij.com",)], "host string"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("shown", X.shown_host("host"))


@query()
def structure_export(spark, sf_dir):
    from gleanery.sources.engine import structures

    return structures(_sample_files(spark))


@query()
def film_rendering(spark, sf_dir):
    """Each benchmark text as a raster of pixels one row high, rendered as a negative."""
    from gleanery.sources.film import Settings, rendered

    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file_id"), F.expr("octet_length(text) div 4").cast("int").alias("width"), F.lit(1).alias("height"), F.encode("text", "UTF-8").alias("raw"))
    rows = b.select("file_id", "width", "height", F.substring("raw", F.lit(1), 4 * F.col("width")).alias("pixels"))
    return rendered(rows, Settings("color-negative")).select("file_id", F.octet_length("rendered").alias("bytes"), F.crc32("rendered").alias("crc32"), "shadows", "highlights")


def _drawn(spark, sf_dir) -> DataFrame:
    """A one-page file for each document: its first word, under a dark box where the id is even, and a word off the page."""
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    content = F.concat(F.lit("BT /F1 10 Tf 50 700 Td ("), word, F.lit(") Tj 0 -200 Td (seen) Tj 900 0 Td (far) Tj ET 0 g "), F.when(F.col("doc_id") % 2 == 0, "40 690 500 30 re f").otherwise("40 100 500 30 re f"))
    body = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Page /MediaBox [0 0 612 792] /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Length "), F.length(content).cast("string"),
        F.lit(" >>\nstream\n"), content, F.lit("\nendstream\nendobj\n%%EOF\n"),
    )
    return table(spark, sf_dir, "documents").where(word != "").select(F.col("doc_id").cast("string").alias("file_id"), F.encode(body, "UTF-8").alias("content"))


_FIRST = "(SELECT doc_id::VARCHAR AS file_id, doc_id, regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1) AS w FROM documents)"


_GLYPHS = "0.0::DOUBLE AS lightness, 1.0::DOUBLE AS alpha, 0 AS mode"


@query(f"""WITH d AS (SELECT *, length(w) AS k FROM {_FIRST} WHERE w <> ''), g AS (SELECT file_id, k, unnest(range(k)) AS i, w FROM d)
SELECT file_id, 0 AS page, 'glyph' AS kind, i AS ordinal, 50.0 + 5 * i AS l, 700.0 AS b, 55.0 + 5 * i AS r, 710.0 AS t, w[i + 1] AS text, {_GLYPHS}, 50 + 5 * i >= 612 AS off_page FROM g
UNION ALL SELECT file_id, 0, 'glyph', k + i, 50.0 + 5 * i, 500.0, 55.0 + 5 * i, 510.0, 'seen'[i + 1], {_GLYPHS}, false FROM d, range(4) x(i)
UNION ALL SELECT file_id, 0, 'glyph', k + 4 + i, 950.0 + 5 * i, 500.0, 955.0 + 5 * i, 510.0, 'far'[i + 1], {_GLYPHS}, true FROM d, range(3) x(i)
UNION ALL SELECT file_id, 0, 'fill', k + 7, 40.0, CASE WHEN doc_id % 2 = 0 THEN 690.0 ELSE 100.0 END, 540.0, CASE WHEN doc_id % 2 = 0 THEN 720.0 ELSE 130.0 END, NULL, {_GLYPHS}, false FROM d
UNION ALL SELECT file_id, 0, 'page', k + 8, 0.0, 0.0, 612.0, 792.0, NULL, 1.0, 1.0, 0, false FROM d""")
def pdf_page_marks(spark, sf_dir):
    from gleanery.sources.pages import page_marks

    return page_marks(_drawn(spark, sf_dir))


@query(f"SELECT file_id, 0 AS page, w AS text FROM {_FIRST} WHERE doc_id % 2 = 0 AND w <> ''")
def pdf_covered_text(spark, sf_dir):
    from gleanery.sources.pages import covered_text

    return covered_text(_drawn(spark, sf_dir))


@query(f"""SELECT file_id, 0 AS page, 'covered' AS kind, w AS text FROM {_FIRST} WHERE doc_id % 2 = 0 AND w <> '' UNION ALL SELECT file_id, 0, 'hiddentext', 'far' FROM {_FIRST} WHERE w <> ''""")
def pdf_findings(spark, sf_dir):
    from gleanery.sources.pages import page_findings

    return page_findings(_drawn(spark, sf_dir))


@query(f"SELECT file_id, 0 AS page, CASE WHEN lower(w) = 'far' THEN 'seen' ELSE w || 'seen' END AS text, CASE WHEN w IN ('far', 'FAR', 'Far') THEN 6 ELSE 3 END AS removed FROM {_FIRST} WHERE w <> '' AND NOT contains(lower(w), 'far')")
def pdf_redacted(spark, sf_dir):
    """The word off the page taken out of every file; what the copies still say."""
    from gleanery.sources.pages import page_marks
    from gleanery.sources.redact import redacted

    files = _drawn(spark, sf_dir).where(~F.lower(F.decode("content", "UTF-8")).rlike(r"td \([a-z]*far[a-z]*\) tj 0 -200"))
    copies = redacted(files, ["far"])
    said = page_marks(copies.select("file_id", F.col("copy").alias("content"))).where("kind = 'glyph'").groupBy("file_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "").alias("text")
    )
    return said.join(copies.select("file_id", "removed"), "file_id")
