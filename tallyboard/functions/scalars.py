"""Column expressions: labels, keys, bands, parsers and hashes. Null rules are explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results, and the scores of White for each.
COMPLETED = ("1-0", "0-1", "1/2-1/2")
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")

# Lower edges and labels of the published bands.
CLOCK_EDGES, CLOCK_LABELS = (10, 30, 60), ("under_10", "10_to_29", "30_to_59", "60_plus")
RATING_EDGES = (1200, 1600, 2000)
RATING_LABELS = ("under_1200", "1200_1599", "1600_1999", "2000_plus")
MODEL_EDGES = (1000, 1600, 2000, 2300)
MODEL_LABELS = ("below-1000", "1000–1599", "1600–1999", "2000–2299", "2300+")
CORPUS_EDGES = (1600, 2000, 2300)
CORPUS_LABELS = ("1000–1599", "1600–1999", "2000–2299", "2300+")
DIFFERENCE_EDGES = (-100, 100)
DIFFERENCE_LABELS = ("below_-100", "-100_to_99", "100_plus")
PHASE_EDGES, PHASE_LABELS = (21, 61), ("early_ply", "middle_ply", "late_ply")
ERROR_CENTIPAWNS = 200
LOSS_CAP = 1000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def family(opening: Column | str) -> Column:
    """Trimmed text before the first colon; blank gives null."""
    return F.nullif(F.trim(F.split_part(col(opening), F.lit(":"), F.lit(1))), F.lit(""))


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(F.trim(col(text)), F.lit(""))


def surrogate_key(*parts: Column | str) -> Column:
    """Parts joined by ``:``; null when any part is null."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(":"))
        pieces.append(col(part).cast("string"))
    return F.concat(*pieces)


def time_control(text: Column | str) -> tuple[Column, Column]:
    """``base+increment`` as two bigints, both null unless the whole text has that shape."""
    c = col(text)
    whole = c.rlike(r"^[0-9]+\+[0-9]+\z")

    def piece(i: int) -> Column:
        return F.when(whole, F.split_part(c, F.lit("+"), F.lit(i)).try_cast("bigint"))

    return piece(1), piece(2)


def utc_struct(date_text: Column | str, time_text: Column | str) -> Column:
    """``yyyy.MM.dd`` and ``HH:mm:ss`` as one struct: date, instant, precision, validity.

    A ``?`` means unknown and gives null. Any other unreadable text is invalid. The
    lambdas bind each step, so a text is parsed once though several fields need it.
    """

    def known(c: Column) -> Column:
        return F.when(c.contains("?") | (c == ""), None).otherwise(c)

    def dated(x: Column) -> Column:
        shaped = x.d.rlike(r"^\d{4}\.\d{1,2}\.\d{1,2}\z")
        day = F.when(shaped, F.try_to_date(x.d, "yyyy.M.d"))
        return F.struct(x.d.alias("d"), x.t.alias("t"), day.alias("day"))

    def timed(x: Column) -> Column:
        shaped = x.day.isNotNull() & x.t.rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}\z")
        at = F.when(
            shaped,
            F.try_to_timestamp(F.concat_ws(" ", x.d, x.t), F.lit("yyyy.M.d H:m:s")),
        )
        return F.struct(x.d.alias("d"), x.t.alias("t"), x.day.alias("day"), at.alias("at"))

    def finished(x: Column) -> Column:
        invalid = (x.d.isNotNull() & x.day.isNull()) | (
            x.day.isNotNull() & x.t.isNotNull() & x["at"].isNull()
        )
        precision = (
            F.when(x["at"].isNotNull(), "second")
            .when(x.day.isNotNull(), "date")
            .otherwise("unknown")
        )
        return F.struct(
            x.day.alias("utc_date"),
            x["at"].alias("played_at"),
            precision.alias("timestamp_precision"),
            F.coalesce(invalid, F.lit(False)).alias("invalid_utc"),
        )

    texts = F.array(F.struct(known(col(date_text)).alias("d"), known(col(time_text)).alias("t")))
    return F.transform(F.transform(F.transform(texts, dated), timed), finished)[0]


def parse_utc(date_text: Column | str, time_text: Column | str) -> dict[str, Column]:
    """The fields of :func:`utc_struct` as separate columns."""
    parts = utc_struct(date_text, time_text)
    names = ("utc_date", "played_at", "timestamp_precision", "invalid_utc")
    return {n: parts.getField(n) for n in names}


def score_from_result(result: Column | str, color: Column | str) -> Column:
    r, c = col(result), col(color)
    won = ((r == "1-0") & (c == "white")) | ((r == "0-1") & (c == "black"))
    return (
        F.when(r == "1/2-1/2", 0.5).when(won, 1.0).when(r.isin("1-0", "0-1"), 0.0).cast("double")
    )


def band(
    value: Column | str,
    edges: Sequence[float],
    labels: Sequence[str],
    *,
    negative_is_null: bool = False,
) -> Column:
    """Half-open bands: ``labels[i]`` below ``edges[i]``, the last label above all; null stays null."""
    if len(labels) != len(edges) + 1 or list(edges) != sorted(edges):
        raise ValueError("bands need sorted edges and one more label than edges")
    c = col(value)
    missing = c.isNull() | (c < 0) if negative_is_null else c.isNull()
    out = F.when(missing, F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(c < edge, label)
    return out.otherwise(labels[-1])


def clock_band(seconds: Column | str) -> Column:
    return band(seconds, CLOCK_EDGES, CLOCK_LABELS, negative_is_null=True)


def rating_band(rating: Column | str) -> Column:
    return band(rating, RATING_EDGES, RATING_LABELS)


def model_band(rating: Column | str) -> Column:
    return band(rating, MODEL_EDGES, MODEL_LABELS)


def corpus_band(rating: Column | str) -> Column:
    return band(rating, CORPUS_EDGES, CORPUS_LABELS)


def difference_band(difference: Column | str) -> Column:
    return band(difference, DIFFERENCE_EDGES, DIFFERENCE_LABELS)


def phase(ply: Column | str) -> Column:
    return band(ply, PHASE_EDGES, PHASE_LABELS)


def in_speed_class(
    base: Column | str, increment: Column | str, low: int = 180, high: int = 480
) -> Column:
    """Estimated length ``base + 40 * increment`` in ``[low, high)``; no base gives false."""
    estimate = col(base) + 40 * F.coalesce(col(increment), F.lit(0))
    return F.coalesce((estimate >= low) & (estimate < high), F.lit(False))


def fingerprint(*cols: Column | str) -> Column:
    """SHA-256 of a canonical JSON object of the named columns, nulls kept."""
    named = F.struct(*[col(c) for c in cols])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def position_id(key: Column | str) -> Column:
    return F.substring(F.sha2(col(key), 256), 1, 24)


def hash_number(text: Column | str, hex_digits: int = 16) -> Column:
    """The first hex digits of the SHA-256 as an exact non-negative decimal."""
    return F.conv(F.substring(F.sha2(col(text), 256), 1, hex_digits), 16, 10).cast("decimal(20,0)")


def hash_sample(identifier: Column | str, modulus: int = 20) -> Column:
    return (hash_number(identifier) % F.lit(modulus)) == 0


def hash_order(identifier: Column | str) -> list[Column]:
    """Sort keys of the deterministic hash order: digest, then the text itself."""
    return [F.sha2(col(identifier), 256), col(identifier)]


def completed(result: Column | str) -> Column:
    return col(result).isin(*COMPLETED)


def deterioration(before: Column | str, after: Column | str, color: Column | str) -> Column:
    """Loss for the mover, never negative, null when either evaluation is missing."""
    b, a = col(before), col(after)
    loss = F.when(col(color) == "white", b - a).otherwise(a - b)
    return F.when(b.isNotNull() & a.isNotNull(), F.greatest(F.lit(0).cast("bigint"), loss))


def error_flag(loss: Column | str) -> Column:
    return col(loss) >= ERROR_CENTIPAWNS


def clamp(
    loss: Column | str, before: Column | str, after: Column | str, cap: int = LOSS_CAP
) -> Column:
    """``least(loss, cap)`` only where both evaluations and the loss are present."""
    value = col(loss)
    ok = col(before).isNotNull() & col(after).isNotNull() & value.isNotNull()
    return F.when(ok, F.least(value, F.lit(cap).cast("bigint")))


def month_period(day: Column | str) -> tuple[Column, Column, Column]:
    """``YYYY-MM``, first day and last day of the month."""
    d = col(day)
    return F.date_format(d, "yyyy-MM"), F.trunc(d, "month"), F.last_day(d)


def route_contains_all(route: Column | str, first: str, moves: Sequence[str]) -> Column:
    """The route starts with ``first`` (and goes on) and every listed move occurs in it."""
    r = col(route)
    wanted = F.array(*[F.lit(m) for m in moves])
    return r.startswith(first + " ") & (F.size(F.array_except(wanted, F.split(r, " "))) == 0)


def route_contains(route: Column | str, move: str) -> Column:
    return F.array_contains(F.split(col(route), " "), move)


def json_field(text: Column | str, path: str) -> Column:
    return F.get_json_object(col(text), path)


def player_key(name: Column | str) -> Column:
    """Folded name; a missing, unknown or anonymous player has no key at all."""
    n = col(name)
    return F.when(n.isNotNull() & ~n.isin("?", "Anonymous"), F.lower(n))


def rated_flag(rated: Column | str, event: Column | str) -> Column:
    """Tri-state flag: the explicit tag, else the event prefix, else unknown."""
    r, e = F.lower(col(rated)), col(event)
    return (
        F.when(r.isin("true", "false"), r == "true")
        .when(e.rlike(r"(?i)^rated\b"), True)
        .when(e.rlike(r"(?i)^(casual|unrated)\b"), False)
    )


def import_date(utc_date: Column | str, date: Column | str) -> Column:
    """The UTC date where given, else the plain date; anything not ``yyyy.MM.dd`` is null."""
    value = F.coalesce(F.nullif(col(utc_date), F.lit("")), col(date))
    return F.when(value.rlike(r"^\d{4}\.\d{2}\.\d{2}\z"), F.try_to_date(value, "yyyy.MM.dd"))


# Hosts, path patterns and id groups of the known providers.
PROVIDERS = {
    "chesscom": {
        "hosts": ("chess.com", "www.chess.com"),
        "path": r"^/game/(live|daily)/(\d+)/?\z",
    },
    "lichess": {
        "hosts": ("lichess.org", "www.lichess.org"),
        "path": r"^/([A-Za-z0-9]{8})(?:[A-Za-z0-9]{4})?(?:/(?:white|black))?/?\z",
    },
}


def provider_identity(
    site: Column | str, link: Column | str, providers: dict[str, dict] | None = None
) -> dict[str, Column]:
    """Provider, native id and an error reason from two address columns.

    ``providers`` maps a name to its hosts and a path pattern; the capture groups
    of the pattern, joined by ``:``, are the native id.
    """
    table = providers or PROVIDERS

    def found(c: Column) -> tuple[Column, Column]:
        brand = F.lower(F.trim(c))
        url = F.regexp_extract(c, r"^(?i:https?)://([^/?#]*)([^?#]*)", 0)
        host = F.lower(F.regexp_extract(c, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]*)", 1))
        path = F.regexp_extract(c, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
        name, native = F.lit(None).cast("string"), F.lit(None).cast("string")
        for provider, rule in table.items():
            groups = rule.get("groups") or (2 if provider == "chesscom" else 1)
            here = (url != "") & host.isin(*rule["hosts"])
            identifier = F.concat_ws(
                ":", *[F.regexp_extract(path, rule["path"], g + 1) for g in range(groups)]
            )
            name = F.when(here | brand.isin(*rule["hosts"]), provider).otherwise(name)
            native = F.when(here & path.rlike(rule["path"]), identifier).otherwise(native)
        return name, native

    p1, n1 = found(col(site))
    p2, n2 = found(col(link))
    return {
        "provider": F.coalesce(p1, p2, F.lit("pgn")),
        "native_id": F.coalesce(n1, n2),
        "reason": F.when(p1 != p2, "conflicting_provider_headers").when(
            n1 != n2, "conflicting_game_id_headers"
        ),
    }


# Ordered keyword rules; the first that matches gives the label.
_CHOICE = r"\b(compare|contrast|versus|against|side.by.side|which .*higher)\b"
LABEL_RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    (
        "unsupported",
        (
            r"\b(caus\w*|prove|cheat\w*|engine assistance|next match|ongoing game|live tournament|"
            r"forecast|predict|personaliz|private games|entire .*archive|every game|everywhere)\b",
        ),
        (),
    ),
    ("coverage", (r"\b(missing ratings|missing opening tags)\b",), ()),
    (
        "clarify",
        (
            r"\b(which opening|those two|two openings i have|that opening|that cohort|"
            r"player color i mean|my chosen|my games|how did they|how common was it)\b",
        ),
        (),
    ),
    (
        "coverage",
        (
            r"\b(first|last) observed|missing|quarantin|excluded|duplicat|"
            r"snapshot|source|selection|selected|quality|utc date|monthly archive|"
            r"byte prefix|ingestion\b",
        ),
        (r"\bopening|clock\b",),
    ),
    ("opening_compare", (_CHOICE, r"\b(opening|defense|game|gambit|lopez)\b"), ()),
    (
        "clock_compare",
        (
            r"\b(clock|seconds|pre.turn|time.left|bucket|proxy|centipawn|"
            r"evaluable|evaluation coverage|deterioration)\b",
            r"\b(compare|contrast|versus|against|differ|between|side by side|which of)\b",
        ),
        (),
    ),
    (
        "clock_bucket",
        (
            r"\b(clock|seconds|pre.turn|time.left|bucket|proxy|centipawn|"
            r"evaluable|evaluation coverage|deterioration)\b",
        ),
        (),
    ),
    ("opening_compare", (_CHOICE,), ()),
    ("opening_score", (r"\b(score|wins|draws|losses|points per|points earned|outcome)\b",), ()),
    (
        "opening_usage",
        (r"\b(how many|count|share|fraction|percentage|proportion|frequency|how common)\b",),
        (),
    ),
)


def rule_label(text: Column | str, rules=LABEL_RULES, default: str = "clarify") -> Column:
    """First rule whose patterns all match and whose exclusions do not."""

    def choose(q: Column) -> Column:
        out = None
        for label, needed, barred in rules:
            hit = F.lit(True)
            for pattern in needed:
                hit = hit & q.rlike(pattern)
            for pattern in barred:
                hit = hit & ~q.rlike(pattern)
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out.otherwise(default)

    # The lambda binds the folded text, which every pattern would else fold again.
    return F.transform(F.array(F.lower(col(text))), choose)[0]


REFUSALS = ("needs_clarification", "unsupported")


def attempt_flags(expected: Column | str, emitted: Column | str) -> dict[str, Column]:
    """Unsafe answer and over-abstention of one attempt."""
    e, o = col(expected), F.coalesce(col(emitted), F.lit(""))
    return {
        "unsafe_answer": (e != "answered") & (o == "answered"),
        "over_abstention": (e == "answered") & o.isin(*REFUSALS),
    }


def failure_mode(
    passed: Column | str,
    unsafe: Column | str,
    over_abstention: Column | str,
    hallucinated: Column | str,
    expected: Column | str,
    emitted: Column | str,
) -> Column:
    """One primary mode of a failed attempt; null for a passed one."""
    e, o = col(expected), col(emitted)
    return (
        F.when(col(passed), None)
        .when(col(unsafe), "unsafe")
        .when(col(over_abstention), "over_abstention")
        .when(col(hallucinated) | o.isNull(), "plan_hallucination")
        .when(e.isin(*REFUSALS) & o.isin(*REFUSALS) & (e != o), "boundary_swap")
        .when((e == o) & (e == "answered"), "wrong_answer")
        .otherwise("other")
    )
