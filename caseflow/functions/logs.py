"""Log-counter expressions. `count_of(name)` gives the counter column of a template (null if missing)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.variants import get, path_of


def counters(logs: Column, *section: str) -> Column:
    """All counters of a section (a name, or a path to it) as a map, read once; null when the section is no object."""
    return get(logs, path_of(*section), "map<string,double>")


def counter(section: Column, template: str) -> Column:
    """Integer counter of one template in a section of `counters`; 0 when missing or not a number."""
    return F.coalesce(F.try_element_at(section, F.lit(template)).try_cast("bigint"), F.lit(0))


def flash_count(count_of: Callable[[str], Column], pairs=vocab.FLASH_PAIRS, single=vocab.FLASH_SINGLE) -> Column:
    """Largest number of complete (active, clear) pairs, or the single-event count if larger."""

    def filled(name: str) -> Column:
        return F.coalesce(count_of(name), F.lit(0))

    complete = [F.least(filled(active), filled(clear)) for active, clear in pairs]
    return F.greatest(*complete, filled(single))


def has_content(logs: Column, *section: str) -> Column:
    """1 when the section (a name, or a path to it) is a non-empty object. Its values are not copied to be counted."""
    size = F.size(get(logs, path_of(*section), "map<string,struct<>>"))
    return F.when(size > 0, F.lit(1)).otherwise(F.lit(0))
