"""Lists that may change or be cut while they are read: read again until they agree, compared with what a search finds, and what is missing told as gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.dashboards import stable_union, unlisted

#: Readings of a list at most, and pages of one at most.
ATTEMPTS, PAGES = 4, 1_000_000


@dataclass
class Listing:
    """objects by id in the order of their first reading; gaps: (key, reason)."""

    objects: dict[str, dict] = field(default_factory=dict)
    gaps: list[tuple[str, str]] = field(default_factory=list)


def read_pages(page: Callable[[int], Sequence[dict]], key: str = "id", size: int = 100, pages: int = PAGES, name: str = "list") -> Listing:
    """All pages of a list, each object once. A full page without a new object means that the list doesn't move on; such a list, one that fails, and one that doesn't end are gaps."""
    out = Listing()
    for n in range(pages):
        try:
            rows = page(n)
        except OSError as e:
            out.gaps.append((name, f"page {n}: {e}"))
            return out
        new = [r for r in rows if str(r[key]) not in out.objects]
        out.objects |= {str(r[key]): r for r in new}
        if len(rows) < size:
            return out
        if not new:
            out.gaps.append((name, f"page {n} repeats objects that were listed before"))
            return out
    out.gaps.append((name, f"more than {pages} pages"))
    return out


def read_until_stable(read: Callable[[], Listing], attempts: int = ATTEMPTS, name: str = "list") -> Listing:
    """Readings of a list until two in a row have the same objects: the union of all. One that doesn't settle is a gap."""
    out = Listing()
    before: set[str] | None = None
    for _ in range(attempts):
        one = read()
        out.objects = one.objects | out.objects
        now = set(one.objects)
        if now == before and not one.gaps:
            return out
        before, gaps = now, one.gaps
    out.gaps += gaps or [(name, f"the list still changed after {attempts} readings")]
    return out


def read_missing(listed: Listing, searched: Iterable[str], read_one: Callable[[str], dict | None], kind: str = "dashboard") -> Listing:
    """listed, and each object that a search finds beside it, read by itself; one that can't be read is a gap of its own."""
    out = Listing(dict(listed.objects), list(listed.gaps))
    for uid in sorted(set(searched) - set(listed.objects)):
        try:
            found = read_one(uid)
        except OSError as e:
            out.gaps.append((f"{kind}:{uid}", str(e)))
            continue
        if found is None:
            out.gaps.append((f"{kind}:{uid}", "a search finds it, and it can't be read"))
        else:
            out.objects[uid] = found
    return out


def by_organisation(organisations: Listing, read: Callable[[str], Listing], own: str) -> Listing:
    """What each organisation holds, its objects' ids preceded by the organisation. Where organisations can't be listed, only one's own is read."""
    out = Listing(gaps=list(organisations.gaps))
    for org in list(organisations.objects) or [own]:
        try:
            one = read(org)
        except OSError as e:
            out.gaps.append((f"organisation:{org}", str(e)))
            continue
        out.objects |= {f"{org}/{k}": v for k, v in one.objects.items()}
        out.gaps += [(f"{org}/{k}", why) for k, why in one.gaps]
    return out


def completeness(searched: DataFrame, *readings: DataFrame, by: str = "uid") -> tuple[DataFrame, DataFrame]:
    """(objects, gaps) of tables: every object of the readings once, and key, reason of each that only the search has."""
    objects = stable_union(*readings, by=by)
    return objects, unlisted(searched, objects, by).select(F.concat(F.lit("object:"), F.col(by).cast("string")).alias("key"), F.lit("a search finds it, and no list holds it").alias("reason"))


def search_pipeline_gaps(pipelines: dict) -> list[tuple[str, str]]:
    """(key, reason) for each search pipeline of a store: it may rewrite a request, so that the audited body isn't what was run."""
    return [(f"search-pipeline:{name}", f"search pipeline {name} may rewrite requests") for name in sorted(pipelines or {})]
