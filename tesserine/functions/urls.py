"""Addresses as Column expressions. Null gives null unless said otherwise; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that name a campaign, for the identity of a source.
CAMPAIGN_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid",
    "ref", "referrer", "source", "cmpid", "spm", "yclid", "_hsenc", "_hsmi", "at_medium", "at_campaign", "ito", "ns_campaign", "ns_mchannel",
)
# The shorter list of the retrieval normaliser.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")
# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.in", "net.in", "org.in", "gov.in", "ac.in", "edu.in", "com.au", "net.au", "org.au",
    "co.nz", "co.jp", "co.kr", "com.br", "com.mx", "com.tr", "com.sg", "com.hk", "co.za", "com.ng", "co.il", "com.ar",
)
# Hosts whose subdomain is the publisher.
PUBLISHER_HOSTS = (
    "wordpress.com", "blogspot.com", "wixsite.com", "weebly.com", "medium.com", "substack.com", "tumblr.com", "notion.site", "github.io",
    "netlify.app", "vercel.app", "pages.dev", "blogger.com", "typepad.com", "ghost.io", "glideapp.io", "squarespace.com",
)
# File extensions by modality.
MODALITIES = {"image": ("jpg", "jpeg", "png", "webp", "bmp", "gif"), "video": ("mp4", "mov", "avi", "mkv", "webm"), "audio": ("wav", "mp3", "m4a", "flac", "ogg", "aac")}


def _authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def host(url: Column) -> Column:
    """Host in lower case without user and port; empty where the address has none."""
    return F.coalesce(F.substring_index(F.regexp_replace(_authority(url), r"^.*@", ""), ":", 1), F.lit(""))


def domain(url: Column) -> Column:
    """Authority in lower case without one leading www. or m.; the port stays."""
    return F.regexp_replace(F.coalesce(_authority(url), F.lit("")), r"^(?:www\.|m\.)", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def _kept(url: Column, dropped: tuple[str, ...]) -> Column:
    """Parameters with a name, without the dropped ones, in their order."""
    return F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*dropped))


def canonical_url(url: Column) -> Column:
    """Identity of a source: host without user and one of www., m., amp.; path without trailing slashes; other than
    campaign parameters, sorted. Scheme and fragment go. Without a host the address in lower case; null gives ''."""
    h = F.regexp_replace(F.regexp_replace(_authority(url), r"^[^@]*@", ""), r"^(?:www\.|m\.|amp\.)", "")
    q = F.array_join(F.array_sort(F.transform(_kept(url, CAMPAIGN_PARAMS), lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")
    full = F.concat(h, F.regexp_replace(path(url), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.coalesce(F.when(h == "", F.lower(F.trim(url))).otherwise(full), F.lit(""))


def normalize_url(url: Column) -> Column:
    """The retrieval normaliser: scheme and www. stay, tracking and empty parameters and the fragment go, order stays."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    q = F.array_join(F.filter(_kept(url, TRACKING_PARAMS), lambda p: F.substring_index(p, "=", -1) != ""), "&")
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(""), _authority(url), F.regexp_replace(path(url), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def registrable_domain(host_col: Column) -> Column:
    """Unit of independence of a host: two labels, three after a suffix of two, the whole host where it is a publisher."""
    h = F.regexp_replace(F.regexp_replace(F.substring_index(F.lower(host_col), ":", 1), r"^\.+|\.+$", ""), r"^(?:www\.|m\.)", "")
    parts = F.filter(F.split(h, r"\."), lambda p: p != "")
    two = F.array_join(F.slice(parts, -2, 2), ".")
    return F.coalesce(
        F.when(F.size(parts) <= 2, h).when(two.isin(*PUBLISHER_HOSTS), h).when(two.isin(*TWO_LABEL_SUFFIXES), F.array_join(F.slice(parts, -3, 3), ".")).otherwise(two), F.lit("")
    )


def path_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(path(url), "/+$", ""))


def alternate_urls(url: Column) -> Column:
    """The address, and without AMP marks, with www. put on or off, and without m.; ordered, distinct."""
    plain = F.regexp_replace(F.regexp_replace(url, r"/amp/?$", ""), r"([?&])amp=1&?", "$1")
    www = F.when(url.rlike(r"://www\."), F.regexp_replace(url, r"://www\.", "://")).otherwise(F.regexp_replace(url, r"://", "://www."))
    return F.array_distinct(F.array_compact(F.array(url, plain, www, F.regexp_replace(url, r"://m\.", "://"))))


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i)https?://\S+$") & (F.length(url) <= 2048), F.lit(False))


def modality(name: Column) -> Column:
    """image, video, audio or text by the extension of a file name."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text")
    for kind, known in MODALITIES.items():
        out = F.when(ext.isin(*known), F.lit(kind)).otherwise(out)
    return out
