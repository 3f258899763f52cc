"""Addresses as column expressions: splitting, query strings, percent coding and the canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import strip

# Query keys that only track, besides those that begin with utm_.
TRACKING = "fbclid gclid dclid msclkid mc_cid mc_eid vero_conv vero_id oly_anon_id oly_enc_id".split()
_WHOLE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PORT = r"(?s)^(?:.*@)?(?:[^\]@]*\][^:]*:(.*)|[^:\]@]*:([^:\]]*))$"
_HOST_PORT = r"(?s)^(?:.*@)?(?:\[([^\]]*)\]|([^:]*))"


def cleaned(c: Column) -> Column:
    """Without tabs and line ends anywhere, nor control signs and spaces at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[\t\r\n]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def split_url(c: Column) -> Column:
    """struct(scheme, netloc, path, query, fragment); '' for a part that is not there."""
    raw = cleaned(c)
    names = ("scheme", "netloc", "path", "query", "fragment")
    parts = [F.regexp_extract(raw, _WHOLE, i + 1) for i in range(5)]
    parts[0] = F.lower(parts[0])
    return F.struct(*(p.alias(n) for p, n in zip(parts, names)))


def hostname(netloc: Column) -> Column:
    return F.lower(F.concat(F.regexp_extract(netloc, _HOST_PORT, 1), F.regexp_extract(netloc, _HOST_PORT, 2)))


def port_text(netloc: Column) -> Column:
    """What stands after the host's colon; '' for none and for a bare literal with several colons."""
    return F.concat(F.regexp_extract(netloc, _PORT, 1), F.regexp_extract(netloc, _PORT, 2))


def port(netloc: Column) -> Column:
    """The explicit port; null for none; -1 for one that is no number from 0 to 65535."""
    text = port_text(netloc)
    number = F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text.cast("int"))
    return F.when(text == "", F.lit(None).cast("int")).when(number.between(0, 65535), number).otherwise(F.lit(-1))


def has_userinfo(netloc: Column) -> Column:
    return netloc.contains("@")


def unquote(c: Column) -> Column:
    """Percent escapes as UTF-8; a broken escape stays, and so does a plus sign."""
    held = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.url_decode(held)).otherwise(c)


def quote(c: Column) -> Column:
    """Every byte but letters, digits and _.-~ as a percent escape."""
    coded = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def quote_plus(c: Column) -> Column:
    return F.replace(quote(c), F.lit("%20"), F.lit("+"))


def parse_query(query: Column) -> Column:
    """array of struct(key, value), decoded, in order; blanks stay."""
    plus = lambda x: unquote(F.replace(x, F.lit("+"), F.lit(" ")))
    one = lambda f: F.struct(plus(F.regexp_extract(f, "(?s)^([^=]*)", 1)).alias("key"), plus(F.regexp_extract(f, "(?s)^[^=]*=(.*)$", 1)).alias("value"))
    return F.transform(F.filter(F.split(query, "&"), lambda f: f != ""), one)


def sort_pairs(pairs: Column) -> Column:
    """By key without case, then value; pairs that differ only in the key's case keep their order."""
    keyed = F.transform(pairs, lambda p, i: F.struct(F.lower(p["key"]).alias("k"), p["value"].alias("v"), i.alias("i"), p["key"].alias("key")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["key"].alias("key"), s["v"].alias("value")))


def encode_query(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(quote_plus(p["key"]), F.lit("="), quote_plus(p["value"]))), "&")


def canonical_query(query: Column) -> Column:
    tracks = lambda k: F.lower(k).startswith("utm_") | F.lower(k).isin(*TRACKING)
    return encode_query(sort_pairs(F.filter(parse_query(query), lambda p: ~tracks(p["key"]))))


def canonical_url(c: Column) -> Column:
    """The address that identifies an article: lower-case scheme and host, no default port, user, fragment or tracking
    keys, a sorted query. Other schemes stay as they are; null marks a bad port, which rejects the address."""
    value = strip(c)
    parts = split_url(value)
    web = parts["scheme"].isin("http", "https")
    number = port(parts["netloc"])
    plain = number.isNull() | (number == 0) | ((parts["scheme"] == "http") & (number == 80)) | ((parts["scheme"] == "https") & (number == 443))
    host = F.concat(hostname(parts["netloc"]), F.when(plain, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string"))))
    path = F.when(parts["path"] == "", F.lit("/")).when(parts["path"].startswith("/"), parts["path"]).otherwise(F.concat(F.lit("/"), parts["path"]))
    query = canonical_query(parts["query"])
    whole = F.concat(parts["scheme"], F.lit("://"), host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(value == "", F.lit("")).when(~web, value).when(number == -1, F.lit(None).cast("string")).otherwise(whole)
