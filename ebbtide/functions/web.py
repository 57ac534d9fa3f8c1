"""Small classifiers of addresses, clicks and user agents. Nulls count as empty text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Routes by name; user-agent marks in order; headers of every path.
ROUTES = {"home": "/", "install": "/installer", "captures": "/captures", "subscriptions": "/abonnements", "memory": "/memoire", "debug": "/debug"}
IN_APP = r"(?i)FBAN|FBAV|Instagram|LinkedInApp|Snapchat|TikTok|musical_ly|BytedanceWebview|Line\/|GSA\/"
BROWSERS = {
    "ios": ((r"(?i)CriOS", "chrome"), (r"(?i)FxiOS", "firefox"), (r"(?i)EdgiOS", "edge"), (r"(?i)Version\/[\d.]+.*Safari\/", "safari"), (r"", "in-app")),
    "android": ((r"(?i); wv\)", "in-app"), (r"(?i)SamsungBrowser", "samsung"), (r"(?i)Firefox\/", "firefox"), (r"(?i)EdgA\/", "edge"), (r"(?i)Chrome\/", "chrome"), (r"", "other")),
    "other": ((r"(?i)Edg\/", "edge"), (r"(?i)Firefox\/", "firefox"), (r"(?i)Chrome\/", "chrome"), (r"(?i)Safari\/", "safari"), (r"", "other")),
}
PRIVATE_ADDRESS = r"^(10\.\d+|172\.(1[6-9]|2\d|3[01])|192\.168)\.\d+\.\d+$"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def normalize_path(path: Column) -> Column:
    """Lower case, no query or fragment, single slashes, none at the end."""
    bare = F.regexp_replace(_text(path), r"(?s)[?#].*$", "")
    single = F.lower(F.regexp_replace(F.concat(F.lit("/"), bare), "/{2,}", "/"))
    return F.when(F.length(single) > 1, F.regexp_replace(single, "/$", "")).otherwise("/")


def resolve_route(path: Column, routes: dict[str, str] | None = None) -> Column:
    clean = normalize_path(path)
    known = ROUTES if routes is None else routes
    return reduce(lambda c, x: c.when(clean == x[1], F.lit(x[0])), known.items(), F).otherwise("notFound")


def operating_system(agent: Column, touch_points: Column) -> Column:
    agent = _text(agent)
    ios = agent.rlike("(?i)iPhone|iPad|iPod") | (agent.rlike("(?i)Macintosh") & (F.coalesce(touch_points, F.lit(0)) > 1))
    return F.when(ios, "ios").when(agent.rlike("(?i)Android"), "android").otherwise("other")


def browser(agent: Column, system: Column) -> Column:
    agent = _text(agent)
    chain = F.when(agent.rlike(IN_APP), F.lit("in-app"))
    for name, rules in BROWSERS.items():
        for pattern, value in rules:
            chain = chain.when((system == name) & agent.rlike(pattern), F.lit(value))
    return chain


def install_guide(system: Column, browser_name: Column, standalone: Column, can_prompt: Column) -> Column:
    ios = F.when(browser_name == "safari", "ios-safari").otherwise("ios-other-browser")
    return (
        F.when(standalone, "installed").when(browser_name == "in-app", "in-app").when(can_prompt, "prompt").when(system == "ios", ios).when(system == "android", "android-manual").otherwise("unsupported")
    )


def origin(url: Column) -> Column:
    """Scheme and host, lower-cased, without the scheme's usual port; null if the address has none."""
    found = lambda k: F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]+)", k))
    bare = F.regexp_replace(F.concat(found(1), F.lit("://"), found(2)), r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    return F.when(found(2) != "", bare)


def intercepts_click(button: Column, modified: Column, prevented: Column, download: Column, target: Column, href: Column, here: Column) -> Column:
    """A plain click on a link of the same origin that opens in place."""
    inside = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), origin(href)).when(href.startswith("//"), origin(F.concat(F.regexp_extract(here, "^[^:]*:", 0), href))).otherwise(here)
    plain = (button == 0) & ~modified & ~prevented & ~download & _text(target).isin("", "_self")
    return plain & F.coalesce(inside == here, F.lit(False))


def shareable_url(address: Column) -> Column:
    return F.concat(F.regexp_replace(address, "/+$", ""), F.lit("/"))


def local_address_issue(host: Column, protocol: Column) -> Column:
    name = F.lower(F.regexp_replace(_text(host), r"^\[|\]$", ""))
    here = name.isin("localhost", "::1", "0.0.0.0") | name.endswith(".localhost") | name.rlike(r"^127\.\d+\.\d+\.\d+$")
    return F.when(here, "this-computer-only").when((protocol != "https:") & (name.rlike(PRIVATE_ADDRESS) | name.endswith(".local")), "no-https")


def policy(directives: Column) -> Column:
    """A map of directive to values as one header value."""
    return F.array_join(F.transform(F.map_entries(directives), lambda e: F.concat(e["key"], F.lit(" "), F.array_join(e["value"], " "))), "; ")


def headers_file(headers: Column) -> Column:
    """A map of headers as the file that sets them on every path."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.concat(F.array(F.lit("/*")), lines, F.array(F.lit(""))), "\n")
