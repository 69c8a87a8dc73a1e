"""Addresses: resolution, which site family they belong to, and whether media may be fetched from them."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and paths of the site families, in the order in which they are tried.
FAMILIES = (
    ("wechat", r"^mp\.weixin\.qq\.com$", r"^/"),
    ("scys-article", r"(^|\.)scys\.com$", r"(?i)^/articleDetail/xq_topic/[^/]+/?$"),
    ("scys", r"(^|\.)scys\.com$", r"(?i)^/(deepsea/[^/]+/course/[^/]+|course/detail/[^/]+)/?$"),
    ("feishu", r"(^|\.)feishu\.cn$", r"^/"),
)
# How pages of each family are collected (merge mode, rounds at the bottom, most rounds, strict, wait in ms).
POLICIES = (
    ("wechat", "latest", 2, 180, False, 700),
    ("scys-article", "latest", 4, 400, False, 1000),
    ("scys", "ordered", 10, None, True, 1000),
    ("feishu", "accumulate", 4, None, False, 900),
    ("generic", "ordered", 4, None, False, 900),
)
#: The families whose pages are collected until the bottom stays the same; others also end where scrolling ends.
STABLE_BOTTOM = ("wechat", "scys-article", "scys")
POLICY_SCHEMA = "adapter string, merge_mode string, stable_rounds int, most_rounds int, strict boolean, wait_ms int"


def host_of(url: Column) -> Column:
    """Lower case, without a last dot; empty without a host."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def site_family(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    out = F.lit(None).cast("string")
    for name, hosts, paths in reversed(FAMILIES):
        out = F.when(host.rlike(hosts) & path.rlike(paths), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("generic"))


def effective_url(url: Column, referrer: Column) -> Column:
    """An embedded course page counts as the activity page that it was opened from, if both are of the same site."""
    course = (site_family(url) == "scys") & path_of(url).rlike(r"(?i)^/course/detail/")
    outer = (site_family(referrer) == "scys") & path_of(referrer).rlike(r"(?i)^/deepsea/")
    return F.when(course & outer, referrer).otherwise(url)


def log_safe(url: Column) -> Column:
    """Without query and fragment; invalid-url for what has no scheme and host."""
    good = F.coalesce(url, F.lit("")).rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+")
    bare = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    return F.when(good, F.when(path_of(url) == "/", F.regexp_replace(bare, r"/?$", "/")).otherwise(bare)).otherwise(F.lit("invalid-url"))


def private_ipv4(host: Column) -> Column:
    """0/8, 10/8, 127/8, 169.254/16, 172.16/12 and 192.168/16."""
    n = F.transform(F.split(host, r"\."), lambda p: p.try_cast("int"))
    four = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(n, lambda p: p <= 255)
    a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    return four & (a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)))


# ---- what needs a real address parser


_IPV4_PART = re.compile(r"0[xX][0-9a-fA-F]*|[0-9]+")


def _web_host(host: str) -> str | None:
    """The host as browsers write it; None if it is none. Numbers of all forms become a dotted address."""
    if host.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(host.strip('[]')).compressed}]"
        except ValueError:
            return None
    parts = host.removesuffix(".").split(".")
    if _IPV4_PART.fullmatch(parts[-1]):
        if len(parts) > 4 or not all(map(_IPV4_PART.fullmatch, parts)):
            return None
        try:
            numbers = [int(p[2:] or "0", 16) if p[:2] in ("0x", "0X") else int(p, 8 if p.startswith("0") and len(p) > 1 else 10) for p in parts]
        except ValueError:
            return None
        if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        return str(ipaddress.IPv4Address(sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1])) + numbers[-1]))
    return host if host and not re.search(r"[\s<>^|%\\]", host) else None


def resolve(src: str | None, base: str | None) -> tuple[str, str, str, str | None] | None:
    """(address, scheme, host, user information) as a browser resolves it; None if it can't."""
    text = re.sub(r"[\t\n\r]", "", (src or "").strip("".join(map(chr, range(33)))))
    try:
        parts = urlsplit(urljoin(base, text) if base else text)
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if not scheme:
        return None
    if scheme not in ("http", "https"):
        return text, scheme, "", None
    raw = parts.netloc.rpartition("@")[2]
    name = raw[: raw.index("]") + 1] if raw.startswith("[") and "]" in raw else raw.partition(":")[0]
    host = _web_host(name.lower())
    if host is None:
        return None
    user = parts.netloc.rpartition("@")[0] or None
    at = "" if port in (None, {"http": 80, "https": 443}[scheme]) else f":{port}"
    path = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._[]|^")
    query = f"?{quote(parts.query, safe='/%:@!$&()*+,;=~-._?[]|^`{}')}" if parts.query else ""
    return f"{scheme}://{host}{at}{path}{query}" + (f"#{parts.fragment}" if parts.fragment else ""), scheme, host, user


# Networks that a page's media may not come from.
_PRIVATE_4 = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16")]
_PRIVATE_6 = [ipaddress.ip_network(n) for n in ("::/128", "::1/128", "fe80::/10", "fc00::/7")]


def _private(host: str) -> bool:
    name = host.removesuffix(".")
    if name == "localhost" or name.endswith((".localhost", ".local")):
        return True
    try:
        address = ipaddress.ip_address(name.strip("[]"))
    except ValueError:
        return False
    if address.version == 6:
        if address.ipv4_mapped is None:
            return any(address in n for n in _PRIVATE_6)
        address = address.ipv4_mapped
    return any(address in n for n in _PRIVATE_4)


def request_of(src: str | None, page: str | None, kind: str) -> tuple[bool, str | None, str | None, str | None]:
    """(ok, reason, address, credentials) of a media address on a page."""
    found = resolve(src, page)
    refuse = lambda why: (False, f"unsafe {kind} URL: {why}", None, None)
    if found is None:
        return refuse("invalid URL")
    href, scheme, host, user = found
    if scheme not in ("http", "https"):
        return refuse("unsupported protocol")
    if user and user != ":":
        return refuse("embedded credentials")
    if _private(host):
        return refuse("local or private destination")
    at = resolve(page, None)
    origin = lambda u: u.split("/")[2:3] + [u.split(":")[0]]
    family = re.compile(r"(^|\.)feishu\.cn$")
    same = at is not None and (origin(at[0]) == origin(href) or (family.search(at[2].rstrip(".")) and family.search(host.rstrip("."))))
    return True, None, href, "include" if same else "omit"


#: Addresses that need no parser: a host of plain names or of four decimal numbers, and a path without escapes or dots at
#: the start of a part.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PLAIN_URL = rf"^https?://(?:(?:[a-z0-9_-]+\.)*[a-z][a-z0-9_-]*|{_OCTET}(?:\.{_OCTET}){{3}})(?:/(?!\.)[A-Za-z0-9_~-][A-Za-z0-9._~-]*)+$"


def media_request(src: Column, page: Column, kind: str = "image") -> Column:
    """ok, reason, href and credentials of a media address. Plain addresses on plain pages are judged by built-in functions;
    only the others are sent to Python."""
    schema = "struct<ok:boolean,reason:string,href:string,credentials:string>"

    @F.pandas_udf(schema)
    def check(sources: pd.Series, pages: pd.Series, asked: pd.Series) -> pd.DataFrame:
        refused = (None, None, None, None)
        return pd.DataFrame([request_of(s, p, kind) if a else refused for s, p, a in zip(sources, pages, asked)], columns=["ok", "reason", "href", "credentials"])

    plain = F.coalesce(src.rlike(PLAIN_URL) & page.rlike(PLAIN_URL), F.lit(False))
    host, own = host_of(src), host_of(page)
    private = (host == "localhost") | host.rlike(r"\.local(?:host)?$") | private_ipv4(host)
    family = r"(^|\.)feishu\.cn$"
    same = ((host == own) & (F.substring_index(src, ":", 1) == F.substring_index(page, ":", 1))) | (host.rlike(family) & own.rlike(family))
    judged = F.when(
        private, F.struct(F.lit(False).alias("ok"), F.lit(f"unsafe {kind} URL: local or private destination").alias("reason"), F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("credentials"))
    ).otherwise(F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"), src.alias("href"), F.when(same, "include").otherwise("omit").alias("credentials")))
    return F.when(plain, judged).otherwise(check(F.when(~plain, src), F.when(~plain, page), ~plain))


def absolute_url(src: Column, base: Column) -> Column:
    """The address as a browser resolves it; the source itself if it can't."""

    @F.pandas_udf("string")
    def make(sources: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([(resolve(s, b) or (s or "",))[0] if s else "" for s, b in zip(sources, bases)], dtype="object")

    return make(src, base)
