"""Columns over HTML, URLs and link responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.fold import deaccent

# Words that say nothing about a page's subject.
STOPWORDS = "the and for with from that this are was page home site www com org net html".split()
# The entities that a title may hold, ampersand first.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#160;", " "), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–")]
#: Responses after which a HEAD request is tried again as GET.
RETRY = (403, 404, 405, 429, 501)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_dot(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def decode_entities(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_title(html: Column) -> Column:
    """Text of the first title element, decoded, white space squeezed; empty if there is none."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))


def title_tokens(title: Column) -> Column:
    words = F.split(F.lower(title), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)))


def title_similarity(a: Column, b: Column) -> Column:
    """Shared title tokens over the smaller set; null if either has none."""
    x, y = title_tokens(a), title_tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def looks_not_found(title: Column) -> Column:
    return F.coalesce(F.lower(title), F.lit("")).rlike(r"\b404\b|not found|page (?:unavailable|missing)|error")


def soft_redirect(redirected: Column, title: Column, page: Column) -> Column:
    return redirected & F.coalesce(title_similarity(title, page) < 0.2, F.lit(False))


def link_status(status: Column) -> Column:
    """dead for 404 and 410, ok for 2xx and 3xx, inconclusive for everything else."""
    return F.when(status.isin(404, 410), F.lit("dead")).when(status.between(200, 399), F.lit("ok")).otherwise(F.lit("inconclusive"))


def link_verdict(head: Column, get: Column, redirected: Column, title: Column, page: Column) -> Column:
    """Verdict on a link from the captured responses to HEAD and, where that is to be retried, GET."""
    status = F.when(F.coalesce(head, F.lit(0)).isin(0, *RETRY), F.coalesce(get, head, F.lit(0))).otherwise(head)
    state = link_status(status)
    suspect = (state == "ok") & (looks_not_found(page) | soft_redirect(redirected, title, page))
    return F.when(suspect, F.lit("suspect")).otherwise(state)


def header_safe(c: Column) -> Column:
    """ASCII text for a header: marks dropped, dashes plain, the rest removed."""
    plain = F.regexp_replace(deaccent(c), r"[‐-―]", "-")
    return F.trim(F.regexp_replace(plain, r"[^\x20-\x7E]", ""))


def site_base(url: Column) -> Column:
    return F.concat(F.regexp_replace(url, r"/+$", ""), F.lit("/"))


def secure_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^http:", "https:")


def base_language(tag: Column) -> Column:
    return F.lower(F.split(F.replace(tag, F.lit("_"), F.lit("-")), "-")[0])


def text_digest(c: Column) -> Column:
    return F.sha2(F.replace(c, F.lit("\r\n"), F.lit("\n")), 256)


#: A glossary marker: [[id]] or [[id|text]].
MARKER = r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]"


def marker_ids(c: Column) -> Column:
    return F.when(c.contains("[["), F.regexp_extract_all(c, F.lit(MARKER), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)"))


def strip_markers(c: Column) -> Column:
    """Markers replaced by their visible text, which is the id where none is given."""
    return F.regexp_replace(F.regexp_replace(c, r"\[\[[^\]|]+\|([^\]]*)\]\]", "$1"), r"\[\[([^\]|]+)\]\]", "$1")


def strip_speaker(c: Column) -> Column:
    return F.replace(c, F.lit(">>"), F.lit("  "))


def snapshot_lookup(status: Column, body: Column) -> Column:
    """(state, archive_url, timestamp) of an answer about snapshots: found, none, or inconclusive where it can't tell.

    A null status is a request that failed.
    """
    told = F.coalesce(status.between(200, 299), F.lit(False))
    answer = F.try_parse_json(body)
    closest = F.try_variant_get(answer, "$.archived_snapshots.closest", "variant")
    url = F.nullif(F.try_variant_get(closest, "$.url", "string"), F.lit(""))
    held = F.coalesce(F.try_variant_get(closest, "$.available", "boolean"), F.lit(False)) & url.isNotNull()
    state = F.when(~told | answer.isNull(), F.lit("inconclusive")).when(held, F.lit("found")).otherwise(F.lit("none"))
    found = state == "found"
    stamp = F.coalesce(F.try_variant_get(closest, "$.timestamp", "string"), F.lit(""))
    return F.struct(state.alias("state"), F.when(found, secure_url(url)).alias("archive_url"), F.when(found, stamp).alias("timestamp"))


def clamp_int(raw: Column, default: int, lo: int, hi: int) -> Column:
    """The whole number that a setting begins with, within its bounds; ``default`` without one."""
    number = F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1).try_cast("decimal(38,0)")
    # ``greatest`` and ``least`` pass over nulls.
    return F.when(number.isNull(), F.lit(default)).otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), number))).cast("long")


def disclaimer(known: Column, reviewed: Column, made_by: Column, machine: str) -> Column:
    """Which disclaimer a translation bears: reviewed, machine if ``made_by`` begins with the program ``machine``, else authored.

    A text that only mentions the program doesn't count. Without provenance (``known`` false) it is authored.
    """
    import re

    by_program = F.trim(made_by).rlike(f"^{re.escape(machine)}\\b")
    own = F.when(reviewed, F.lit("reviewed")).when(by_program, F.lit("machine")).otherwise(F.lit("authored"))
    return F.when(known, own).otherwise(F.lit("authored"))
