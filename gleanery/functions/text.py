"""Text functions as Catalyst expressions: addresses, accounts, links, hosts, code meanings, guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.dims import NOT_DOMAINS, NOT_PEOPLE, POSED, RISKY, SHARED_SUFFIXES, SHORTENERS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(x: Column) -> Column:
    """A-Z lower-cased; matching is by ASCII throughout."""
    return F.translate(x, UPPER, LOWER)


def one_of(x: Column, words: list[str]) -> Column:
    return x.isin(*words)


def distinct_first(found: Column) -> Column:
    """An array without later elements that equal an earlier one but for the case of A-Z."""
    folded = F.transform(found, lower)
    return F.filter(found, lambda x, i: F.array_position(folded, lower(x)) == i + 1)


def emails(text: Column, excluded: tuple[str, ...] = ("example.com",)) -> Column:
    """Addresses in order of appearance: a name with a letter, and a domain that ends in a word of letters."""
    raw = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,128})"), F.lit(1))
    tidy = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[.+-]+", ""), r"[.-]+$", ""))

    def is_one(x: Column) -> Column:
        name, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
        top = F.substring_index(domain, ".", -1)
        ok = name.rlike("[A-Za-z]") & domain.contains(".") & top.rlike("^[A-Za-z]{2,}$") & ~one_of(lower(top), NOT_DOMAINS)
        ok = ok & (name != "git")
        for e in excluded:
            ok = ok & ~domain.endswith(e)
        return ok

    return distinct_first(F.filter(tidy, is_one))


def home_accounts(text: Column) -> Column:
    """Accounts that paths of home folders name, without those that are nobody's."""
    word = r"([A-Za-z0-9._ -]{1,64})"
    names = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (f"/Users/{word}/", rf"\\Users\\{word}\\", f"/home/{word}/")])
    return distinct_first(F.filter(names, lambda x: ~one_of(lower(x), NOT_PEOPLE)))


def ipv4(text: Column) -> Column:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({octet}\.{octet}\.{octet}\.{octet})\b"), F.lit(1)))


def private_ipv4(address: Column) -> Column:
    """Addresses that no one on the internet has: 10/8, 172.16/12, 192.168/16, 127/8, 169.254/16."""
    return address.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)")


def ipv6(text: Column) -> Column:
    """Address literals of eight groups, or of fewer with one ``::`` for the rest, lower case, each once."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*)"), F.lit(1)), lower)

    def is_one(x: Column) -> Column:
        gaps = F.size(F.split(x, "::", -1)) - 1
        groups = F.size(F.array_remove(F.split(x, ":", -1), ""))
        clean = x.rlike("^(:|[0-9a-f]{1,4})(:[0-9a-f]{0,4})*$") & ~x.rlike(":::|[^:]:$|^:[^:]|[0-9a-f]{5}")
        return clean & (((gaps == 0) & (groups == 8)) | ((gaps == 1) & (groups <= 7) & (groups >= 1)))

    return F.array_distinct(F.filter(raw, is_one))


def private_ipv6(address: Column) -> Column:
    """Addresses of one's own network: fc00::/7, fe80::/10, ::1."""
    return address.rlike("^(f[cd]|fe[89ab])[0-9a-f]{0,2}:|^::1$")


def listed(found: Column, most: int = 4) -> Column:
    """The first few, and how many more."""
    more = F.when(F.size(found) > most, F.concat(F.lit(" and "), (F.size(found) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(found, 1, most), ", "), more)


def host(href: Column) -> Column:
    """The host a web link goes to, lower case; null for other links and hosts without a dot."""
    at = F.regexp_extract(lower(F.trim(href)), r"^https?://([^/?#]*)", 1)
    h = F.substring_index(F.substring_index(at, "@", -1), ":", 1)
    return F.when(h.contains("."), F.regexp_replace(h, r"\.+$", ""))


def named(words: Column) -> Column:
    """The site that a link's words name: a web address or one bare domain; else null."""
    t = F.regexp_replace(F.trim(words), "[/.,]+$", "")
    bare = F.regexp_extract(lower(t), r"^([^/?#\s]*)(?:[/?#]\S*)?$", 1)
    return F.coalesce(host(t), F.when(bare.rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}$"), bare))


def base_domain(domain: Column) -> Column:
    """The registered part: the last two labels, or three under a shared suffix."""
    two = F.substring_index(domain, ".", -2)
    return F.when(one_of(two, SHARED_SUFFIXES), F.substring_index(domain, ".", -3)).otherwise(two)


def says_elsewhere(words: Column, to_host: Column) -> Column:
    """Whether a link's words name another site than ``to_host``; false if they name none."""
    said = F.regexp_replace(named(words), r"^(www\.)+", "")
    return F.coalesce(base_domain(said) != base_domain(to_host), F.lit(False))


def entities(text: Column) -> Column:
    """The named entities lt, gt, quot, apos and nbsp, numeric ones, and amp last, decoded once each."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.replace(numeric_entities(text), F.lit("&amp;"), F.lit("&"))


def numeric_entities(text: Column) -> Column:
    """``&#65;`` and ``&#x41;`` as the characters they number; what numbers none stays."""

    def one(part: Column) -> Column:
        head = F.regexp_extract(part, r"(?i)^&#(x[0-9a-f]{1,6}|[0-9]{1,7});", 1)
        code = F.when(F.lower(F.substring(head, 1, 1)) == "x", F.conv(F.substring(head, 2, 6), 16, 10)).otherwise(head).cast("long")
        real = (head != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(real, F.concat(char, F.regexp_replace(part, "^&#[^;]*;", ""))).otherwise(part)

    return F.when(text.contains("&#"), F.array_join(F.transform(F.split(text, "(?=&#)", -1), one), "")).otherwise(text)


def visible_words(html: Column) -> Column:
    """The words of a page: scripts, styles, comments and tags gone, blanks folded."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    t = entities(F.regexp_replace(t, "<[^>]*>", " "))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))


def links(html: Column) -> Column:
    """An array of ``<a href=…>…</a>`` elements as (href, words)."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), F.lit(1))
    made = F.transform(
        found,
        lambda a: F.struct(
            F.regexp_extract(a, r"""(?i)^<a\s[^>]*?\bhref\s*=\s*["']([^"'>]*)["']""", 1).alias("href"), visible_words(a).alias("words")
        ),
    )
    return F.filter(made, lambda x: x["href"] != "")


def risky(name: Column) -> Column:
    """The class of a file that does harm when opened, with what it poses as; null for others."""
    ext = F.regexp_extract(lower(name), r"\.([^.]*)$", 1)
    before = F.regexp_extract(lower(name), r"([^.]*)\.[^.]*$", 1)
    kind = F.coalesce(*[F.when(one_of(ext, exts), kind) for kind, exts in RISKY.items()])
    return F.when(kind.isNotNull(), F.concat(kind, F.when(one_of(before, POSED) & name.rlike(r"\..*\."), F.concat(F.lit(" as "), before)).otherwise("")))


#: What a scanned code is, in order of testing.
CODE_KINDS = [
    ("qrwifi", "(?i)^WIFI:"), ("qrsecret", "(?i)^otpauth://"), ("qrplace", "(?i)^geo:"),
    ("qrcontact", "(?i)^(BEGIN:VCARD|MECARD:)"), ("qrtext", "(?i)^(mailto|tel|smsto|sms):"),
]


def code_kind(text: Column) -> Column:
    """What a scanned code's text is: a finding kind."""
    t = F.trim(text)
    authority = F.regexp_extract(t, r"(?i)^https?://([^/?#]*)", 1)
    h = host(t)
    trick = authority.contains("@") | h.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") | h.rlike(r"(^|\.)xn--")
    out = F.when(t.rlike("(?i)^https?://.") & F.coalesce(trick, F.lit(False)), "qrtrick").when(t.rlike("(?i)^https?://."), "qrlink").otherwise("qrtext")
    for kind, pattern in reversed(CODE_KINDS):
        out = F.when(t.rlike(pattern), kind).otherwise(out)
    return out


def code_field(text: Column, key: str) -> Column:
    """A ``KEY:value;`` field of a network or contact code, its escapes undone; empty without one."""
    return F.regexp_replace(F.regexp_extract(text, rf"(?i)(?:^|[:;]){key}:((?:\\.|[^;\\])*)", 1), r"\\(.)", "$1")


def code_starts(text: Column) -> Column:
    """What a code sets off, and with whom: ``mail x``, ``call x``, ``message x``; null for other codes."""
    t = F.trim(text)
    scheme = F.lower(F.regexp_extract(t, "(?i)^(mailto|tel|smsto|sms):", 1))
    to = _unescaped(F.regexp_extract(t, "(?i)^[a-z]+:([^?:]*)", 1), "%")
    what = F.when(scheme == "mailto", "mail ").when(scheme == "tel", "call ").when(scheme != "", "message ")
    return F.concat(what, to)


def code_warnings(text: Column) -> Column:
    """Why a code's link should not be trusted, as an array: user part, number address, foreign letters, short link."""
    t = F.trim(text)
    h, authority = host(t), F.regexp_extract(t, r"(?i)^https?://([^/?#]*)", 1)
    tests = {"user part": authority.contains("@"), "number address": h.rlike(r"^[0-9.]+$"), "foreign letters": h.rlike(r"(^|\.)xn--"), "short link": short_link(t)}
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in tests.items()]))


def short_link(href: Column) -> Column:
    return F.coalesce(one_of(F.regexp_replace(host(href), r"^www\.", ""), SHORTENERS), F.lit(False))


def csv_cell(x: Column) -> Column:
    """A CSV cell: guarded where a sheet would take it for a formula, quoted where it has to be."""
    safe = F.when(x.rlike(r"^[\t\r ]*[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def sanitised(x: Column) -> Column:
    """Control characters as U+FFFD, one for one."""
    return F.regexp_replace(x, "[\\x00-\\x1F\\x7F]", "�")


def extension(path: Column) -> Column:
    """What follows the last dot of the last part of a path, lower case; empty without one."""
    return F.regexp_extract(lower(F.regexp_extract(path, r"([^/]*)$", 1)), r".\.([a-z0-9]+)$", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def unsafe_path(path: Column) -> Column:
    """Paths that leave the folder they are unpacked in."""
    return path.rlike(r"^/|\\|^[A-Za-z]:|(^|/)\.\.(/|$)")


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, quoted or not; null where there is none."""
    hit = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = F.regexp_replace(F.regexp_replace(hit, r"^\s[^=]*=\s*", ""), r"""^["']|["']$""", "")
    return F.when(hit != "", entities(value))


def _unescaped(text: Column, mark: str) -> Column:
    """Bytes written as ``mark`` and two hex digits undone; UTF-8 comes out, what is none as U+FFFD."""
    digits = "[0-9A-Fa-f]{2}"

    def one(part: Column) -> Column:
        coded = part.rlike(f"^{mark}{digits}")
        plain = lambda x: F.encode(x, "UTF-8")
        return F.when(coded, F.concat(F.unhex(F.substring(part, 2, 2)), plain(F.substring(part, 4, 1 << 30)))).otherwise(plain(part))

    parts = F.transform(F.split(text, f"(?={mark}{digits})", -1), one)
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
    return F.when(text.rlike(mark + digits), F.decode(joined, "UTF-8")).otherwise(text)


def percent_decoded(text: Column) -> Column:
    return _unescaped(text, "%")


def quoted_printable(text: Column) -> Column:
    """A quoted-printable body: soft line ends gone, ``=XX`` as bytes of UTF-8; a stray ``=`` stays."""
    return _unescaped(F.regexp_replace(text, "=[ \\t]*\r?\n", ""), "=")


def base64_decoded(text: Column) -> Column:
    """A base64 body as bytes: what is no sign of the alphabet is passed over, an end that is missing is made up; null for none."""
    bare = F.regexp_replace(F.regexp_replace(text, "=.*", ""), "[^A-Za-z0-9+/]", "")
    whole = F.when(F.char_length(bare) % 4 == 1, bare.substr(F.lit(1), F.char_length(bare) - 1)).otherwise(bare)
    return F.unbase64(F.rpad(whole, (F.ceil(F.char_length(whole) / 4) * 4).cast("int"), F.lit("=")))


def header_parameter(value: Column, name: str) -> Column:
    """``name=value`` of a header's list, quotes undone; ``name*=charset'language'value`` and its numbered pieces (``name*0*``,
    ``name*1``, in order) with their percent signs undone; null where there is none."""
    plain = F.regexp_extract(value, rf"""(?i);\s*{name}\s*=\s*("[^"]*"|[^;\s]+)""", 1)
    said = rf"""(?i);\s*{name}\*(?:[0-9]+\*?)?\s*=\s*("[^"]*"|[^;\s]*)"""
    pieces = F.regexp_extract_all(value, F.lit(said), F.lit(1))
    joined = F.replace(F.array_join(pieces, ""), F.lit('"'), F.lit(""))
    extended = percent_decoded(F.regexp_replace(joined, "^[A-Za-z0-9-]*'[A-Za-z-]*'", ""))
    return F.when(F.size(pieces) > 0, extended).when(plain != "", F.replace(plain, F.lit('"'), F.lit("")))


def mailbox_domain(value: Column) -> Column:
    """The domain of a mailbox (``Name <a@b.org>`` or ``a@b.org``), lower case; null without one."""
    inner = F.regexp_extract(value, r"<([^<>]*)>\s*$", 1)
    d = F.regexp_extract(lower(F.trim(F.when(inner != "", inner).otherwise(value))), r"@([a-z0-9.-]+?)\.*$", 1)
    return F.when(d != "", d)


def goes_elsewhere(from_: Column, other: Column) -> Column:
    """Whether a reply-to or return-path mailbox belongs to another site than the sender's; false where one names none."""
    return F.coalesce(base_domain(mailbox_domain(from_)) != base_domain(mailbox_domain(other)), F.lit(False))


def computer_name(received: Column) -> Column:
    """The host that the first hop names, if it sounds like someone's computer; null otherwise."""
    name = F.regexp_extract(received, r"(?i)^\s*from\s+([A-Za-z0-9._-]+)", 1)
    return F.when(name.rlike(r"(?i)\.(local|lan|home)$|macbook|-pc$|^desktop-|^laptop-"), name)


# ---- XML, by patterns: for documents of any size, well formed or not


def xml_elements(xml: Column, tag: str) -> Column:
    """All elements of a tag (with any prefix), as (attributes, body); the body of an empty element is empty."""
    whole = rf"(?s)(<(?:[\w.-]+:)?{tag}(?:\s[^<>]*)?(?:/>|>.*?</(?:[\w.-]+:)?{tag}\s*>))"
    found = F.regexp_extract_all(xml, F.lit(whole), F.lit(1))
    return F.transform(
        found,
        lambda x: F.struct(
            F.regexp_extract(x, rf"(?s)^<(?:[\w.-]+:)?{tag}(\s[^<>]*?)?/?>", 1).alias("attributes"),
            F.regexp_replace(F.regexp_replace(x, r"(?s)^<[^<>]*>", ""), r"(?s)</[^<>]*>$", "").alias("body"),
        ),
    )


def xml_text(xml: Column, tag: str) -> Column:
    """The text of the first element of a tag, its inner tags gone and entities decoded; null without one."""
    first = F.get(xml_elements(xml, tag), F.lit(0))
    return F.when(first.isNotNull(), entities(F.regexp_replace(first["body"], "<[^>]*>", "")))


def xml_attribute(xml: Column, tag: str, name: str) -> Column:
    """An attribute of the first element of a tag; null without one."""
    return attribute(F.concat(F.lit("<x"), F.get(xml_elements(xml, tag), F.lit(0))["attributes"], F.lit(">")), name)


# ---- elements of pages, which unlike XML have letters of any case, no prefixes and no end in the start tag


def page_elements(html: Column, tag: str) -> Column:
    """All elements of a tag of a page as they are written, from a start tag to the next end tag."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:[ \t\n\f\r][^<>]*)?>.*?</{tag}>"), F.lit(0))


def page_title(html: Column) -> Column:
    """The title of a page as its source has it, blanks around it gone and ``&amp;`` decoded; empty without one."""
    said = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    return F.replace(F.coalesce(F.regexp_replace(said, r"^\p{Zs}+|\p{Zs}+\z", ""), F.lit("")), F.lit("&amp;"), F.lit("&"))


# ---- numbers at an offset of bytes


def _reversed(h: Column, size: int) -> Column:
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def number_at(content: Column, offset: Column, size: int, little: bool = True, signed: bool = False) -> Column:
    """The integer of 1, 2, 4 or 8 bytes at an offset from 0, as a decimal; null where the bytes do not reach."""
    h = F.hex(F.substring(content, offset + 1, F.lit(size)))
    n = F.conv(_reversed(h, size) if little else h, 16, 10).cast("decimal(20,0)")
    full, half = F.lit(str(1 << 8 * size)).cast("decimal(20,0)"), F.lit(str(1 << (8 * size - 1))).cast("decimal(20,0)")
    value = F.when(n >= half, n - full).otherwise(n) if signed else n
    return F.when((offset >= 0) & (offset + size <= F.octet_length(content)), value.cast("decimal(20,0)"))


def unix_time_at(content: Column, offset: Column, little: bool = True) -> Column:
    """The four bytes at an offset as seconds since 1970, where that is a date from 1980 to 2100; null otherwise."""
    s = number_at(content, offset, 4, little).cast("long")
    return F.when(s.between(315_532_800, 4_102_444_800), F.concat(F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))


def bits_at(content: Column, offset: Column) -> Column:
    return F.lpad(F.bin(number_at(content, offset, 1).cast("long")), 8, "0")


@F.pandas_udf(T.DoubleType())
def float_at(content, offset, size, little):
    """The floating-point number of 4 or 8 bytes at an offset; null where the bytes do not reach."""
    import struct

    def one(c, o, n, le):
        return struct.unpack_from(("<" if le else ">") + ("f" if n == 4 else "d"), c, o)[0] if c is not None and o >= 0 and o + n <= len(c) else None

    import pandas as pd

    return pd.Series([one(*x) for x in zip(content, offset, size, little)], dtype="float64")


def utc_offset(date: Column) -> Column:
    """The time zone of a mail's date, as ``UTC±hh:mm``."""
    z = F.regexp_extract(date, r"([+-][0-9]{4})(?:\s|$)", 1)
    return F.when(z != "", F.concat(F.lit("UTC"), F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2)))


def human_size(n: Column) -> Column:
    """Bytes in words: B, KB, MB, GB by 1024, one decimal below ten."""
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    x = n / F.pow(F.lit(1024.0), step)
    shown = F.when((step == 0) | (x >= 10), F.format_string("%d", F.floor(x).cast("long"))).otherwise(F.format_string("%.1f", F.floor(x * 10) / 10))
    return F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, ["B", "KB", "MB", "GB"])), step + 1))


def fixed(value: Column, places: int) -> Column:
    """A number with ``places`` decimals, half away from zero by its shortest decimal form, no sign on zero."""
    text = F.round(value.cast("decimal(30,12)"), places).cast(f"decimal(30,{places})").cast("string")
    plain = F.when(text.rlike(r"^-0(\.0*)?$"), F.substring(text, 2, 40)).otherwise(text)
    return F.when(F.isnan(value), "NaN").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(plain)


@F.pandas_udf(T.StringType())
def shown_host(host):
    """A host with each punycode label as its letters; labels that don't decode stay."""

    def letters(label: str) -> str:
        try:
            return label[4:].encode().decode("punycode") if label.startswith("xn--") else label
        except (UnicodeError, ValueError):
            return label

    return host.map(lambda h: None if h is None else ".".join(map(letters, h.split("."))))


@F.pandas_udf(T.StringType())
def decoded_words(value):
    """Encoded words of a mail header (RFC 2047) as text; what doesn't decode stays."""
    from email.header import decode_header, make_header

    def plain(v):
        try:
            return None if v is None else str(make_header(decode_header(v)))
        except (LookupError, ValueError):
            return v

    return value.map(plain)
