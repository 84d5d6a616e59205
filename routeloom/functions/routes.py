"""Normal forms of HTTP methods, paths, URLs, services and handlers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The verbs that outbound calls may name.
CALL_VERBS = ("get", "post", "put", "delete", "patch")
#: Host labels and client names that say nothing about a service.
GENERIC_HOST_LABELS = ("api", "apis", "internal", "service", "services", "svc", "client", "gateway", "localhost", "127")
GENERIC_CLIENTS = ("requests", "httpx", "axios", "fetch", "client")
#: Handler names that mean there is none.
NO_HANDLER = ("none", "null", "unknown", "n/a")


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """``c`` is looked at once, where a comparison would have it computed twice, and its parts four times."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit("(?s).+"), F.lit(0)), F.lit(1))


def method(c: Column) -> Column:
    """Trimmed and upper case; blank is null."""
    return blank_to_null(F.upper(strip(c)))


def call_verb(c: Column) -> Column:
    """The first of the five call verbs that stands in ``c`` as a word, upper case; else null."""
    return blank_to_null(F.upper(F.regexp_extract(F.lower(c), rf"\b({'|'.join(CALL_VERBS)})\b", 1)))


def _rooted(c: Column) -> Column:
    return F.regexp_replace(c, r"\A(?!/)", "/")


def _one_slash_off(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=.)/\z", "")


def path(c: Column) -> Column:
    """Leading slash, one trailing slash off; blank is null."""
    return _one_slash_off(_rooted(blank_to_null(strip(c))))


def declared_path(c: Column) -> Column:
    """As :func:`path`, but a blank declaration is the root."""
    return F.coalesce(path(c), F.when(c.isNotNull(), F.lit("/")))


def collapsed_path(c: Column) -> Column:
    """As :func:`declared_path`, with runs of slashes made one; null is the root too."""
    return _one_slash_off(F.regexp_replace(_rooted(strip(F.coalesce(c, F.lit("")))), "/+", "/"))


def angle_params(c: Column) -> Column:
    """``<int:id>`` and ``<id>`` become ``{id}``."""
    return F.regexp_replace(c, r"<(?:[^:>]+:)?([^>]+)>", r"{$1}")


def colon_params(c: Column) -> Column:
    """``:id`` becomes ``{id}``."""
    return F.regexp_replace(c, r"(?U):([A-Za-z_]\w*)", r"{$1}")


def path_identity(c: Column) -> Column:
    """One form for the path templates of all frameworks."""
    return path(colon_params(angle_params(path(c))))


def unified_path(c: Column) -> Column:
    """Leading slash, all trailing slashes off; what validators of generated contracts compare."""
    return F.coalesce(blank_to_null(F.regexp_replace(_rooted(strip(c)), r"/+\z", "")), F.when(c.isNotNull(), F.lit("/")))


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"""^["']+|["']+$""", "")


def api_path(c: Column) -> Column:
    """The path of a URL or path: no scheme, host, query or fragment; slashes made one; parameters as they are."""
    bare = F.regexp_replace(_unquoted(c), r"\Ahttps?://[^/?#]*", "")
    cut = blank_to_null(strip(F.regexp_extract(bare, r"(?s)^[^?#]*", 0)))
    return _one_slash_off(F.regexp_replace(_rooted(cut), "/{2,}", "/"))


def url_service(c: Column) -> Column:
    """The first host label of a URL that is neither generic nor a number, lower case."""
    host = F.lower(F.regexp_extract(strip(c), r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.filter(F.split(host, r"\."), lambda p: (p != "") & ~p.isin(*GENERIC_HOST_LABELS) & ~p.rlike("^[0-9]+$"))
    return F.try_element_at(labels, F.lit(1))


def client_service(c: Column) -> Column:
    """What a client's variable name says about its service: the last dotted part without its suffix."""
    last = F.lower(F.element_at(F.split(c, r"\."), -1))
    bare = F.regexp_replace(F.regexp_replace(last, "_(client|service|api)$", ""), "(client|service|api)$", "")
    token = blank_to_null(F.btrim(bare, F.lit("_- ")))
    return F.when(token.isin(*GENERIC_CLIENTS), F.lit(None)).otherwise(token)


def service(c: Column) -> Column:
    return blank_to_null(F.lower(strip(c)))


def join_paths(prefix: Column, leaf: Column) -> Column:
    """Prefix and leaf as one path; the root is neutral on either side."""
    p, q = collapsed_path(prefix), collapsed_path(leaf)
    return F.when(p == "/", q).when(q == "/", p).otherwise(F.concat(p, q))


def handler(c: Column) -> Column:
    """Without brackets and punctuation at both ends; names that mean none are null."""
    bare = F.regexp_replace(strip(c), r"(?U)^[\s,;:()\[\]{}]+|[\s,;:()\[\]{}]+$", "")
    return F.when(F.lower(bare).isin(*NO_HANDLER), F.lit(None)).otherwise(blank_to_null(bare))


def posix_path(c: Column) -> Column:
    """Forward slashes, one at a time, and no ``.`` segments."""
    flat = F.regexp_replace(F.replace(blank_to_null(strip(c)), F.lit("\\"), F.lit("/")), r"/(\./|/)+", "/")
    return F.regexp_replace(F.regexp_replace(flat, r"^(\./)+(?=.)", ""), r"(?<=.)(/\.?)+$", "")


def has_path_parameter(c: Column) -> Column:
    return c.rlike(r"\{[^}]+\}|:[A-Za-z_][A-Za-z0-9_]*|<[^>]+>")


def path_parameters(c: Column) -> Column:
    """Names of the parameters of a path template, each once, those in braces first, then colons, then angles."""
    families = (r"\{([A-Za-z_][A-Za-z0-9_]*)\}", r":([A-Za-z_][A-Za-z0-9_]*)", r"<(?:[^:>]+:)?([A-Za-z_][A-Za-z0-9_]*)>")
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in families]
    # a colon inside angles belongs to a converter, not to a parameter
    found[1] = F.regexp_extract_all(F.regexp_replace(c, "<[^>]*>", ""), F.lit(families[1]), F.lit(1))
    return F.array_distinct(F.concat(*found))


def static_segments(c: Column) -> Column:
    """Segments of a path that are no parameters."""
    return F.filter(F.split(F.btrim(strip(c), F.lit("/")), "/"), lambda s: (s != "") & ~s.startswith("{") & ~s.startswith(":"))


def entity_label(c: Column) -> Column:
    """The last static segment, in the singular, in words."""
    last = F.replace(F.try_element_at(static_segments(c), F.lit(-1)), F.lit("-"), F.lit("_"))
    one = F.when(last.endswith("ies") & (F.length(last) > 3), F.regexp_replace(last, "ies$", "y")).when(
        last.endswith("s") & ~last.endswith("ss") & (F.length(last) > 3), F.regexp_replace(last, "s$", "")
    ).otherwise(last)
    return F.coalesce(blank_to_null(strip(F.replace(one, F.lit("_"), F.lit(" ")))), F.lit("record"))


def route_token(c: Column) -> Column:
    """A path as one word."""
    parts = F.filter(F.split(F.replace(F.btrim(strip(c), F.lit("/")), F.lit("-"), F.lit("_")), "/"), lambda s: s != "")
    words = F.transform(parts, lambda s: F.coalesce(blank_to_null(F.btrim(F.regexp_replace(F.lower(s), r"(?U)[^\p{Alnum}]", "_"), F.lit("_"))), F.lit("segment")))
    return F.coalesce(blank_to_null(F.array_join(words, "_")), F.lit("root"))


def lookup_id(repo: Column, file: Column, verb: Column, route: Column) -> Column:
    return F.concat_ws(":", F.coalesce(repo, F.lit("")), F.coalesce(file, F.lit("")), F.coalesce(call_verb(verb), F.lit("ANY")), F.coalesce(api_path(route), F.lit("?")))
