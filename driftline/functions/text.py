"""Names, times and sentences as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: formats that stored rows and readers share
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
STAMP = "yyyyMMdd'T'HHmmss'Z'"
KEY_SHAPE = "^espk_[A-Za-z0-9_-]{43}$"
MARKDOWN = r"([\\*_~`|>#<\[\]()\-:.!+=])"
CONTROL = r"[\x00-\x1f\x7f-\x9f  ]"
KEY = r"([A-Za-z]+)\s*[:=]"
BEELINE = "Beeline: %s walks straight to players out of sight"
AMBUSH = "Ambush: %s of %s waits ended with a distant player arriving"
CONTACT, NO_CONTACT = "Time to contact: median %s after spawning", "Time to contact: no contact after spawning"
DETAILS = (
    *(f"beeline.{c}" for c in ("score", "episodes", "null_episodes", "moving_minutes", "z")),
    *(f"ambush.{c}" for c in ("score", "hits", "waits", "null_hits", "z")),
    *(f"ttc.{c}" for c in ("score", "median_ttc_s", "server_median_ttc_s", "episodes", "contacts", "z")),
)
LEAKAGE = (
    "leakage z %s (sub-score %s): players nobody could have seen predict this player's moves %s nats per move better than "
    "the same players at other times, over %d moves (%s h observed)"
)
TOO_FEW = "; too few moves to score (needs %d)"
ELLIPSIS, ZERO_WIDTH = "…", "​"


def stored_time(at: Column) -> Column:
    """Fixed-width text of a time, in the session's zone, which is UTC."""
    return F.date_format(at, TIME)


def parsed_time(text: Column) -> Column:
    return F.to_timestamp(text, TIME)


def window_name(org: Column, end: Column) -> Column:
    return F.concat(org, F.lit("-"), F.date_format(end, STAMP))


def partition_name(end: Column) -> Column:
    return F.concat(F.lit("date="), F.date_format(end, "yyyy-MM-dd"))


def key_hash(key: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(key.cast("binary"), 256))


def looks_like_key(text: Column) -> Column:
    return F.coalesce(text.rlike(KEY_SHAPE), F.lit(False))


def line_shape(line: Column) -> Column:
    """The names of a line's fields in their order, so that a line can be logged without what it says."""
    return F.substring(F.array_join(F.regexp_extract_all(line, F.lit(KEY), F.lit(1)), " "), 1, 200)


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, the last of them an ellipsis where something was cut, and no escape left open before it."""
    cut = F.substring(text, 1, most - 1)
    open_ = F.length(F.regexp_extract(cut, r"(\\*)$", 1)) % 2 == 1
    whole = F.when(open_, F.substring(text, 1, most - 2)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(whole, F.lit(ELLIPSIS)))


def cleaned(text: Column, most: int = 64) -> Column:
    """Text for one line: no control characters, not too long, never empty."""
    out = truncated(F.btrim(F.regexp_replace(text, CONTROL, " ")), most)
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("(no name)")).otherwise(out)


def escaped(text: Column) -> Column:
    """Text that shows as it is where markdown and mentions are understood."""
    return F.replace(F.regexp_replace(text, MARKDOWN, r"\\$1"), F.lit("@"), F.lit("@" + ZERO_WIDTH))


def html_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def joined(items: Column, most: int, separator: str = ", ") -> Column:
    """As many items as fit, and how many more there are."""
    n = F.size(items)
    first = lambda k: F.array_join(F.slice(items, F.lit(1), k), separator)
    more = lambda k: F.when(k < n, F.concat(F.lit(f"{separator}+"), (n - k).cast("string"), F.lit(" more"))).otherwise("")
    texts = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.concat(first(k), more(k)))
    fits = F.get(F.filter(texts, lambda t: F.length(t) <= most), F.lit(0))
    return F.when(n > 0, F.coalesce(fits, truncated(items[0], most))).otherwise("")


def held(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once for each row, however often it is used."""
    return F.transform(F.array(value), then)[0]


def rounded(value: Column, places: int) -> Column:
    """|value| x 10^places as the nearest integer to what the double really holds, ties to even.

    The product's rounding error is worked out exactly, by splitting the double in halves: 0.35 is less than its decimals.
    """
    scale = float(10**places)

    def nearest(y: Column, part: Column) -> Column:
        big = part * 134217729.0
        high = big - (big - part)
        product = part * scale
        error = (high * scale - product) + (part - high) * scale
        whole = F.floor(y) * F.lit(10**places) + F.floor(product)
        over = (product - F.floor(product).cast("double")) - 0.5
        up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        return whole + up.cast("long")

    return held(F.abs(value), lambda y: held(y - F.floor(y).cast("double"), lambda part: nearest(y, part)))


def fixed(value: Column, places: int, plus: bool = False) -> Column:
    """A finite number below 10^15 with so many places, like printf on the double's exact value."""
    point = lambda d: F.concat(F.substr(d, F.lit(1), F.length(d) - places), F.lit("."), F.substr(d, F.length(d) - places + 1, F.lit(places)))
    digits = lambda n: F.lpad(n, F.greatest(F.lit(places + 1), F.length(n)), F.lit("0"))
    text = lambda n: held(digits(n), point) if places else digits(n)
    return held(value, lambda v: F.concat(F.when(v < 0, "-").otherwise("+" if plus else ""), held(rounded(v, places).cast("string"), text)))


def number(text: Column, places: int = 0) -> Column:
    """A number from stored details as JSON has it: integers as they are, others rounded; a question mark for what is none."""
    def said(text: Column, value: Column) -> Column:
        sane = F.coalesce(~F.isnan(value) & (F.abs(value) < 1e15), F.lit(False))
        shown = fixed(value, places) if places else F.regexp_replace(fixed(value, 0), "^-0$", "0")
        return F.when(~sane, "?").when(text.rlike("^-?[0-9]+$"), value.cast("long").cast("string")).otherwise(shown)

    return held(text, lambda t: held(t.try_cast("double"), lambda v: said(t, v)))


def duration(text: Column) -> Column:
    """Seconds, or minutes from ten on."""
    return held(text.try_cast("double"), lambda v: F.when(v < 600, F.concat(fixed(v, 0), F.lit(" s"))).otherwise(F.concat(fixed(v / 60, 0), F.lit(" min"))))


def behaviours(details: Column) -> Column:
    """Sentences for the behaviours that made a score, from the details' JSON; those absent or at zero are left out.

    Each number is looked up in the text once, and the text itself made once.
    """
    looked_up = lambda text: F.struct(*[F.get_json_object(text, f"$.{path}").alias(path.replace(".", "_")) for path in DETAILS])
    return held(details, lambda text: held(looked_up(text), _sentences))


def _sentences(numbers: Column) -> Column:
    raw = lambda path: numbers.getField(path.replace(".", "_"))
    at = lambda path: raw(path).try_cast("double")
    said = lambda path: F.coalesce(at(path) >= 0, F.lit(False)) & (at(path) < float("inf"))
    positive = lambda name: F.coalesce((at(f"{name}.score") > 0) & (at(f"{name}.score") < float("inf")), F.lit(False))
    part = lambda path, before, places, after="": F.when(raw(path).isNotNull(), F.concat(F.lit(before), number(raw(path), places), F.lit(after)))
    extras = lambda *parts: held(F.array_join(F.array(*parts), ", "), lambda text: F.when(text == "", "").otherwise(F.concat(F.lit(" ("), text, F.lit(")"))))
    blank = lambda c: F.coalesce(c, F.lit(""))
    of = lambda path: F.coalesce(number(raw(path)), F.lit("?"))
    beeline = F.concat(F.format_string(BEELINE, of("beeline.episodes")), blank(part("beeline.null_episodes", " vs ", 1, " expected")), extras(part("beeline.moving_minutes", "in ", 0, " min of moving"), part("beeline.z", "z ", 1)))
    ambush = F.concat(F.format_string(AMBUSH, of("ambush.hits"), of("ambush.waits")), blank(part("ambush.null_hits", " vs ", 1, " expected")), extras(part("ambush.z", "z ", 1)))
    median = F.when(said("ttc.median_ttc_s"), F.format_string(CONTACT, duration(raw("ttc.median_ttc_s")))).otherwise(NO_CONTACT)
    server = F.when(said("ttc.server_median_ttc_s"), F.concat(F.lit(" vs "), duration(raw("ttc.server_median_ttc_s")), F.lit(" server median"))).otherwise("")
    spawns = F.when(raw("ttc.episodes").isNotNull(), F.concat(blank(part("ttc.contacts", "", 0, " contacts in ")), of("ttc.episodes"), F.lit(" spawns")))
    contact = F.concat(median, server, extras(spawns, part("ttc.z", "z ", 1)))
    return F.array_compact(F.array(F.when(positive("beeline"), beeline), F.when(positive("ambush"), ambush), F.when(positive("ttc"), contact)))


def gain_summary(z: Column, score: Column, gain: Column, moves: Column, stride_s: float, least: int = 120) -> Column:
    """What a leakage score says, in a sentence; and if so, that there are too few moves for one."""
    hours = moves * F.lit(float(stride_s)) / F.lit(3600.0)
    said = F.format_string(LEAKAGE, fixed(z, 1), fixed(score, 2), fixed(gain, 3, plus=True), moves, fixed(hours, 1))
    return F.concat(said, F.when(moves < least, TOO_FEW % least).otherwise(""))
