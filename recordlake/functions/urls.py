"""Url and host expressions."""

from __future__ import annotations

from collections.abc import Sequence

from ..constants import (
    BARE_DOMAIN,
    BINARY_URL,
    BLOCKED_URL_PATTERNS,
    FREE_MAIL_DOMAINS,
    FREE_MAIL_STEMS,
    PLATFORM_HOSTS,
    REDIRECT_URL,
    SITE_SEARCH_PATH,
    TRACKING_PREFIXES,
)
from .text import alternation, bind, match, one_of, q, replace, strip, strip_end

# scheme, authority, path, query, fragment
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"


def is_http(url: str) -> str:
    return f"(startswith({url}, 'http://') OR startswith({url}, 'https://'))"


def _decode_form(text: str) -> str:
    # A percent sign that starts no escape stands for itself.
    return f"try_url_decode({replace(text, '%(?![0-9A-Fa-f]{2})', '%25')})"


def _encode_form(text: str) -> str:
    return f"replace(replace(url_encode({text}), '*', '%2A'), '%7E', '~')"


def decode_percent(text: str) -> str:
    """Percent decoding that leaves ``+`` alone."""
    return _decode_form(f"replace({text}, '+', '%2B')")


def canonical_url(url: str) -> str:
    """Lower-case host, no fragment, no trailing slash, no tracking parameters."""
    tracking = f"^(?:{alternation(TRACKING_PREFIXES)})"

    def query(u: str) -> str:
        pairs = (
            f"filter(transform(filter(split({match(u, PARTS, 4)}, '&'), p -> contains(p, '=')), p -> named_struct("
            f"'k', {_decode_form(match('p', '^([^=]*)='))}, 'v', {_decode_form(match('p', '^[^=]*=(.*)$'))})), "
            f"p -> p.v <> '' AND NOT lower(p.k) RLIKE {q(tracking)})"
        )
        text = f"array_join(transform({pairs}, p -> concat({_encode_form('p.k')}, '=', {_encode_form('p.v')})), '&')"
        kept = bind(text, lambda t: f"CASE WHEN {t} = '' THEN '' ELSE concat('?', {t}) END")
        return f"CASE WHEN contains({u}, '?') THEN {kept} ELSE '' END"

    def build(u: str) -> str:
        path = strip_end(match(u, PARTS, 3), "/")
        return (
            f"CASE WHEN contains({u}, '://') THEN concat(lower({match(u, PARTS, 1)}), '://', lower({match(u, PARTS, 2)}), "
            f"coalesce(nullif({path}, ''), '/'), {query(u)}) ELSE {u} END"
        )

    return bind(f"translate({strip(url)}, {q(chr(9) + chr(10) + chr(13))}, '')", build)


def host_of(url: str) -> str:
    """Lower-case host name without user and port; '' when the url has none."""
    return f"lower({match(url, _HOST)})"


def strip_www(host: str) -> str:
    return replace(host, r"^www\.", "")


def registrable_host(host: str) -> str:
    """Last two labels (no public-suffix list), '' for a single label."""
    return bind(
        strip_www(f"lower({host})"),
        lambda h: f"CASE WHEN contains({h}, '.') THEN substring_index({h}, '.', -2) ELSE '' END",
    )


def path_of(url: str) -> str:
    return f"coalesce(nullif({match(url, PARTS, 3)}, ''), '/')"


def query_of(url: str) -> str:
    return match(url, PARTS, 4)


def is_blocked_url(url: str, patterns: Sequence[str] = BLOCKED_URL_PATTERNS) -> str:
    if not patterns:
        return "false"
    return f"lower({url}) RLIKE {q(alternation(p.lower() for p in patterns))}"


def is_binary_url(url: str) -> str:
    return f"lower({url}) RLIKE {q(BINARY_URL)}"


def is_site_search(url: str) -> str:
    """Pages that echo the search phrase back."""
    return (
        f"({path_of(url)} RLIKE {q(SITE_SEARCH_PATH)} "
        f"OR (endswith({strip_end(path_of(url), '/')}, '/search') AND {query_of(url)} <> ''))"
    )


def unwrap_redirect(url: str) -> str:
    """Target of a search engine's ``/url?q=`` wrapper."""
    return bind(
        url,
        lambda u: f"CASE WHEN contains({u}, '/url?') THEN "
        + bind(decode_percent(match(u, REDIRECT_URL)), lambda t: f"CASE WHEN {is_http(t)} THEN {t} ELSE {u} END")
        + f" ELSE {u} END",
    )


def is_free_mail(domain: str) -> str:
    return (
        f"({one_of(domain, FREE_MAIL_DOMAINS)} OR {one_of(registrable_host(domain), FREE_MAIL_DOMAINS)} "
        f"OR {one_of(f'''substring_index({domain}, '.', 1)''', FREE_MAIL_STEMS)})"
    )


def is_platform_host(host: str) -> str:
    return one_of(registrable_host(host), PLATFORM_HOSTS)


def host_name(host: str) -> str:
    """Entity name guessed from a host: its first label, capitalised."""
    return bind(
        strip_www(f"lower({host})"),
        lambda h: bind(
            f"substring_index({h}, '.', 1)",
            lambda s: f"CASE WHEN contains({h}, '.') AND length({s}) >= 3 AND NOT {s} RLIKE '^[0-9]+$' "
            f"THEN concat(upper(left({s}, 1)), substr({s}, 2)) END",
        ),
    )


def email_domain(email: str) -> str:
    return f"substring_index({email}, '@', -1)"


def contact_urls(site: str) -> str:
    """Pages of a site where an address is looked for, in this order."""
    return f"array({site}, concat({strip_end(site, '/')}, '/contact'))"


def promote_bare_domain(text: str) -> str:
    return f"CASE WHEN {text} RLIKE {q(BARE_DOMAIN)} THEN concat('https://', {text}) END"
