"""Scalar functions of requests, labels and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes taken for web addresses when typed without a scheme.
COMMON_TLDS = ("com", "org", "net", "edu", "gov", "io", "dev", "app", "ai", "co", "uk", "us", "de", "fr", "in", "ca", "au", "jp", "eu", "me", "tv", "info", "biz", "online", "site", "tech", "cloud", "xyz")
#: Engines and where they take a query.
ENGINES = {"duckduckgo": "https://duckduckgo.com/?q=", "google": "https://www.google.com/search?q="}


def percent_encoded(c: Column) -> Column:
    """RFC 3986: unreserved characters as they are, all other bytes as upper-case hexadecimal."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_url(engine: Column, query: Column) -> Column:
    base = F.lit(None).cast("string")
    for name, url in ENGINES.items():
        base = F.when(F.lower(engine) == name, F.lit(url)).otherwise(base)
    return F.concat(base, percent_encoded(query))


def mode(query: Column) -> Column:
    """`web`, `install`, `local` if the query begins with that word and white space follows; else null."""
    m = F.regexp_extract(F.lower(query), "^\\s*(web|install|local)\\s", 1)
    return F.when(m != "", m)


def mode_rest(query: Column) -> Column:
    """The query without its mode word, trimmed."""
    return F.when(mode(query).isNotNull(), F.trim(F.regexp_replace(query, "^\\s*\\w+\\s+", ""))).otherwise(query)


def valid_host(host: Column) -> Column:
    label = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    return host.rlike(f"^{label}(\\.{label})*$") & (F.length(host) <= 253)


def valid_port(port: Column) -> Column:
    return port.rlike("^[0-9]{1,5}$") & F.try_to_number(F.when(port.rlike("^[0-9]{1,5}$"), port), F.lit("99999")).between(1, 65535)


def web_address(text: Column) -> Column:
    """Whether the text is an address: http(s) with a valid host or an IPv6 literal in brackets, dotted IPv4, or a host with a common suffix; optional
    port and path; never a path or a text with white space or bytes that no URI has."""
    parts = "^(?i:(https?)://)?(\\[[0-9A-Fa-f:.]+\\]|[^/?#:\\s]+)(?::([0-9]+))?([/?#].*)?$"
    scheme, host, port = (F.regexp_extract(text, parts, i) for i in (1, 2, 3))
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    ipv4 = host.rlike(f"^{octet}(\\.{octet}){{3}}$")
    suffix = F.lower(F.element_at(F.split(host, "\\."), -1)).isin(*COMMON_TLDS) & F.contains(host, F.lit("."))
    clean = ~text.rlike("[\\x00-\\x20\\x7F\\\\<>\"`]") & ~text.rlike("%(?![0-9A-Fa-f]{2})")
    named = valid_host(host) & ((scheme != "") | ipv4 | suffix)
    return F.coalesce(clean & text.rlike(parts) & ((port == "") | valid_port(port)) & (named | ((scheme != "") & ipv6_literal(host))), F.lit(False))


def ipv6_literal(host: Column) -> Column:
    """Whether a bracketed text is an IPv6 address: eight groups of up to four hexadecimal digits, one run of them `::`, the last
    two perhaps dotted."""
    inner = F.regexp_extract(host, "^\\[(.*)\\]$", 1)
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    dotted = f"{octet}(\\.{octet}){{3}}$"
    # a dotted end stands for two groups
    plain = F.when(inner.rlike(f":{dotted}"), F.regexp_replace(inner, dotted, "0:0")).otherwise(inner)
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    sides = F.split(plain, "::", -1)
    shape = plain.rlike("^(|[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)(::(|[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*))?$")
    n = F.size(groups(plain))
    return F.coalesce((inner != "") & shape & F.when(F.size(sides) == 2, n <= 7).otherwise(n == 8), F.lit(False))


def display_escaped(c: Column) -> Column:
    """Backslashes doubled and control characters as \\xNN, for lines of text."""
    out = F.replace(F.make_valid_utf8(c), F.lit("\\"), F.lit("\\\\"))
    for code in [*range(1, 32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\x{code:02X}"))
    return out


def octal_unescaped(c: Column) -> Column:
    """Every \\ooo of mount tables as the byte it names."""
    hexed = F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "$1 ")
    value = lambda m: F.lpad(F.hex(F.conv(m, 8, 10).cast("int")), 2, "0")
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit("\\\\([0-3][0-7]{2})"), 1))
    of = lambda m: F.concat(F.lit("5C "), F.regexp_replace(F.hex(m), "(..)", "$1 "))
    out = F.aggregate(codes, hexed, lambda s, m: F.replace(s, of(m), F.concat(value(m), F.lit(" "))))
    return F.when(F.size(codes) > 0, F.decode(F.unhex(F.replace(out, F.lit(" "), F.lit(""))), "utf-8")).otherwise(c)


def query_key(query: Column, most: int = 32) -> tuple[Column, Column]:
    """A normalised query as history keeps it: trimmed, blanks collapsed, `most` symbols; and whether that is all of it."""
    whole = F.trim(F.regexp_replace(query, "[ \\t\\n\\r]+", " "))
    return F.rtrim(F.left(whole, F.lit(most))), F.length(whole) <= most


def desktop_embedding_text(name: Column, generic: Column, keywords: Column) -> Column:
    """What is embedded of an application: its name, generic name and keywords."""
    return F.translate(F.concat(name, F.lit(" "), F.coalesce(generic, F.lit("")), F.lit(" "), F.coalesce(keywords, F.lit(""))), ";", " ")


def path_member(path: Column) -> Column:
    """How a raw path (binary) goes into JSON: `path` where it is UTF-8, else `path_b64`."""
    text = F.when(F.is_valid_utf8(path.cast("string")), path.cast("string"))
    return F.to_json(F.struct(text.alias("path"), F.when(text.isNull(), F.base64(path)).alias("path_b64")))


def path_of_member(line: Column) -> Column:
    """The raw path of path_member()."""
    return F.coalesce(F.get_json_object(line, "$.path").cast("binary"), F.unbase64(F.get_json_object(line, "$.path_b64")))


def embedding_text(path: Column) -> Column:
    """The last three components of a path, separators as blanks, camel case split."""
    last = F.array_join(F.slice(F.split(path, "/"), -F.least(F.size(F.split(path, "/")), F.lit(3)), F.lit(3)), "/")
    return F.translate(F.regexp_replace(last, "(?<=[a-z])(?=[A-Z])", " "), "/_-.", "    ")


def short_parent(path: Column) -> Column:
    """The last two folders above an entry, behind an ellipsis if there are more."""
    up = F.filter(F.split(F.regexp_replace(path, "/[^/]*$", ""), "/"), lambda p: p != "")
    return F.when(F.size(up) <= 2, F.concat(F.lit("/"), F.array_join(up, "/"))).otherwise(F.concat(F.lit("…/"), F.array_join(F.slice(up, -2, 2), "/")))


def desktop_name(label: Column) -> Column:
    return F.concat(F.lower(F.translate(label, " ", "-")), F.lit(".desktop"))


def suggestion_gate(query: Column) -> Column:
    """Whether a query may suggest software: no path, address or file-like symbol in it."""
    return ~query.rlike("[/\\\\:.@]")


def software_ref_valid(scope: Column, app_id: Column) -> Column:
    return scope.rlike("^(user|system|system:[A-Za-z0-9_-]+)$") & app_id.rlike("^[A-Za-z_][A-Za-z0-9_-]*(\\.[A-Za-z0-9_-]+){2,}$")


#: What stands between a window's title and its application's name.
TITLE_SEPARATORS = (" - ", " – ", " — ")


def short_title(title: Column, app: Column) -> Column:
    """A title without the application's name behind its last separator: the whole name, its first or last words, or text that
    ends with its first word, in any case."""
    parts = f"(?s)^(.+)(?:{'|'.join(TITLE_SEPARATORS)})(.*)$"
    rest, name = F.lower(F.regexp_extract(title, parts, 2)), F.lower(app)
    first = F.split(name, " ")[0]
    named = (rest == name) | name.startswith(F.concat(rest, F.lit(" "))) | name.endswith(F.concat(F.lit(" "), rest)) | rest.endswith(F.concat(F.lit(" "), first))
    return F.when(title.rlike(parts) & (rest != "") & (name != "") & named, F.regexp_extract(title, parts, 1)).otherwise(title)


def single_line(c: Column) -> Column:
    """Valid text in one line: what is no UTF-8 replaced, control characters as blanks."""
    return F.regexp_replace(F.make_valid_utf8(c), "[\\x00-\\x1F\\x7F]", " ")


def keyword_text(keywords: Column, most: int = 4096) -> Column:
    """Keywords joined by blanks, as many whole ones as fit into so many bytes."""
    fit = F.aggregate(keywords, F.struct(F.lit("").alias("t"), F.lit(True).alias("on")), lambda s, k: F.when(s["on"] & (F.octet_length(k) <= most - F.octet_length(s["t"])), F.struct(F.concat(s["t"], k, F.lit(" ")).alias("t"), F.lit(True).alias("on"))).otherwise(F.struct(s["t"].alias("t"), F.lit(False).alias("on"))))
    return F.rtrim(fit["t"])


def label_key(label: Column, prefix: str = "/apps/") -> Column:
    """The path under which an application's label is searched: its slashes are blanks."""
    return F.concat(F.lit(prefix), F.translate(label, "/", " "))
