"""URL normalisation and checks (F1, V5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col, let
from ._regex import strip_ws
from .links import ascii_host, resolve_url

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]*)(.*)$"
_AUTH = r"^(?:([^@]*)@)?([^:@]*)(?::([0-9]*))?$"


def normalize_url(col) -> Column:
    """Absolute http(s) URL in canonical text form: scheme and host
    lower-cased, default port dropped, ``/`` for an empty path, spaces in
    the rest escaped as ``%20``.  Anything that is not an absolute http or
    https URL with a host gives NULL."""
    return let(strip_ws(as_col(col)), _normalize)


def normalize_link(base, ref) -> Column:
    """A link of a page as an absolute URL in that form: resolved against the page's address, a
    host of another script as punycode (a large expression, so ``normalize_url`` goes without)."""
    host = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?)([^/?#:]*)(.*)$"
    encoded = let(resolve_url(base, ref), lambda u: F.when(u.rlike(r"^[^/]*//[^/?#]*[^\x00-\x7f]"), F.concat(
        F.regexp_extract(u, host, 1), ascii_host(F.regexp_extract(u, host, 2)), F.regexp_extract(u, host, 3))).otherwise(u))
    return normalize_url(encoded)


def _normalize(u: Column) -> Column:
    parts = F.struct(F.lower(F.regexp_extract(u, _URL, 1)).alias("scheme"),
                     F.regexp_extract(u, _URL, 2).alias("authority"),
                     F.regexp_extract(u, _URL, 3).alias("rest"),
                     u.rlike(_URL).alias("ok"))
    return let(parts, _assemble)


def _assemble(p: Column) -> Column:
    scheme, authority, rest = p["scheme"], p["authority"], p["rest"]
    auth = F.struct(F.regexp_extract(authority, _AUTH, 1).alias("userinfo"),
                    F.lower(F.regexp_extract(authority, _AUTH, 2)).alias("host"),
                    F.regexp_extract(authority, _AUTH, 3).alias("port"),
                    authority.rlike(_AUTH).alias("ok"))

    def build(a):
        userinfo, host, port = a["userinfo"], a["host"], a["port"]
        default_port = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        port_txt = F.when((port == "") | default_port, F.lit("")).otherwise(F.concat(F.lit(":"), port))
        user_txt = F.when(userinfo == "", F.lit("")).otherwise(F.concat(userinfo, F.lit("@")))
        path = F.when((rest == "") | rest.startswith("?") | rest.startswith("#"), F.concat(F.lit("/"), rest)) \
                .otherwise(rest)
        path = F.replace(path, F.lit(" "), F.lit("%20"))
        ok = (p["ok"] & scheme.isin("http", "https") & a["ok"] & (host != "") & host.rlike(r"^[a-z0-9.-]+$"))
        return F.when(ok, F.concat(scheme, F.lit("://"), user_txt, host, port_txt, path))
    return let(auth, build)


def is_http_url(col) -> Column:
    """V5: the value normalises to an absolute http/https URL."""
    return normalize_url(col).isNotNull()
