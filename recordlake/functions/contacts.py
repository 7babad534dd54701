"""E-mail addresses in text."""

from __future__ import annotations

from ..constants import EMAIL_CHARS, PLACEHOLDER_EMAIL_DOMAINS, PLACEHOLDER_EMAIL_LOCALS
from .text import bind, extract, match_all, one_of
from .urls import email_domain, is_free_mail, registrable_host

# The look-behind keeps the scan linear on long runs of address characters; \G
# lets a new address start right behind the last one.
EMAIL = rf"(?:\G|(?<![{EMAIL_CHARS}]))[{EMAIL_CHARS}]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}"


def first_email(text: str) -> str:
    return extract(text, EMAIL)


def is_placeholder_email(email: str) -> str:
    return (
        f"({one_of(email_domain(email), PLACEHOLDER_EMAIL_DOMAINS)} OR "
        f"{one_of(f'''substring_index({email}, '@', 1)''', PLACEHOLDER_EMAIL_LOCALS)})"
    )


def emails(text: str) -> str:
    """Every address in reading order, lower case."""
    return f"transform({match_all(text, EMAIL)}, e -> lower(e))"


def preferred_email(text: str, host: str) -> str:
    """Own-domain address first, then any that is not free mail, then the first.

    Placeholder addresses do not count.
    """

    def pick(site: str) -> str:
        domain = email_domain("e")
        usable = f"filter({emails(text)}, e -> NOT {is_placeholder_email('e')})"
        return (
            f"array_min(transform({usable}, (e, i) -> named_struct("
            f"'cls', CASE WHEN {site} <> '' AND {registrable_host(domain)} = {site} THEN 0 "
            f"WHEN NOT {is_free_mail(domain)} THEN 1 ELSE 2 END, 'pos', i, 'email', e))).email"
        )

    return bind(registrable_host(host), pick)
