"""X14 country flag lookup as a literal map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country alias (lower case, English and German) -> flag,
# as used by the dashboard.  Unknown or missing -> DEFAULT_FLAG.
COUNTRY_FLAGS = [
    ("austria", "🇦🇹"), ("österreich", "🇦🇹"),
    ("germany", "🇩🇪"), ("deutschland", "🇩🇪"),
    ("italy", "🇮🇹"), ("italien", "🇮🇹"),
    ("switzerland", "🇨🇭"), ("schweiz", "🇨🇭"),
    ("netherlands", "🇳🇱"), ("niederlande", "🇳🇱"),
    ("belgium", "🇧🇪"), ("belgien", "🇧🇪"),
    ("france", "🇫🇷"), ("frankreich", "🇫🇷"),
    ("uk", "🇬🇧"), ("united kingdom", "🇬🇧"), ("great britain", "🇬🇧"),
    ("spain", "🇪🇸"), ("spanien", "🇪🇸"),
    ("portugal", "🇵🇹"),
    ("poland", "🇵🇱"), ("polen", "🇵🇱"),
    ("czech republic", "🇨🇿"), ("tschechien", "🇨🇿"), ("czechia", "🇨🇿"),
    ("slovakia", "🇸🇰"), ("slowakei", "🇸🇰"),
    ("hungary", "🇭🇺"), ("ungarn", "🇭🇺"),
    ("romania", "🇷🇴"), ("rumänien", "🇷🇴"),
    ("slovenia", "🇸🇮"), ("slowenien", "🇸🇮"),
    ("croatia", "🇭🇷"), ("kroatien", "🇭🇷"),
    ("serbia", "🇷🇸"), ("serbien", "🇷🇸"),
    ("bosnia", "🇧🇦"), ("bosnien", "🇧🇦"),
    ("uae", "🇦🇪"), ("united arab emirates", "🇦🇪"),
    ("usa", "🇺🇸"), ("united states", "🇺🇸"), ("us", "🇺🇸"),
    ("japan", "🇯🇵"),
    ("china", "🇨🇳"),
    ("sweden", "🇸🇪"), ("schweden", "🇸🇪"),
    ("norway", "🇳🇴"), ("norwegen", "🇳🇴"),
    ("denmark", "🇩🇰"), ("dänemark", "🇩🇰"),
    ("finland", "🇫🇮"),
    ("ireland", "🇮🇪"), ("irland", "🇮🇪"),
    ("turkey", "🇹🇷"), ("türkei", "🇹🇷"),
    ("greece", "🇬🇷"), ("griechenland", "🇬🇷"),
    ("bulgaria", "🇧🇬"), ("bulgarien", "🇧🇬"),
]
DEFAULT_FLAG = "🌍"


def flag_expr(country) -> Column:
    """Same lookup as a literal CASE map, for use inside a projection."""
    m = F.create_map(*[F.lit(x) for kv in COUNTRY_FLAGS for x in kv])
    c = F.col(country) if isinstance(country, str) else country
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(c))), F.lit(DEFAULT_FLAG))
