"""Domain classifications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.functions.accounts import letters_only
from dunlake.functions.base import ColumnLike, first_match, is_blank, lookup, number, text


def assign_brand(
    origin: ColumnLike,
    potential: ColumnLike,
    pre_potential: ColumnLike,
    write_off: ColumnLike,
    refinanced: ColumnLike,
    age: ColumnLike,
    campaign: ColumnLike | None = None,
    box_origins: Sequence[str] = ("RR", "SGA"),
) -> Column:
    """Delinquency brand of an account from its marks, origin and age bucket.

    Without ``campaign`` the special sub-brand is never given; ``box_origins``
    are the origins whose marked accounts are called churn.
    """
    source = text(origin)

    def marked(mark: ColumnLike) -> Column:
        return text(mark) == "Y"

    def by_origin(mark: ColumnLike, mobile: str, box: str, device: str):
        return [
            (marked(mark) & (source == "BSCS"), F.lit(mobile)),
            (marked(mark) & source.isin(*box_origins), F.lit(box)),
            (marked(mark) & (source == "ASCARD"), F.lit(device)),
        ]

    none_marked = (text(potential) == "N") & (text(pre_potential) == "N") & (text(write_off) == "N")
    brand = first_match(
        by_origin(potential, "Potencial", "Churn", "Provision")
        + by_origin(pre_potential, "Prepotencial", "Prechurn", "Preprovision")
        + [
            (marked(write_off), F.lit("Castigo")),
            (none_marked & marked(refinanced), F.lit("Potencial a Castigar")),
        ],
        text(age),
    )
    rules = [(brand.isin("120", "150", "180"), F.lit("120 - 180"))]
    if campaign is not None:
        special = (brand == "Prepotencial") & (source == "BSCS") & text(campaign).isin(*fixed.SPECIAL_CAMPAIGNS)
        rules.append((special, F.lit("Prepotencial Especial")))
    return first_match(rules, brand)


def segment(code: ColumnLike) -> Column:
    return F.when(text(code).isin(*fixed.PERSON_SEGMENT_CODES), F.lit("Personas")).otherwise(F.lit("Negocios"))


def document_type(document: ColumnLike) -> Column:
    """Document kind from the letters of a typed id."""
    letters = letters_only(document)
    return F.when(letters.isNull() | (letters == ""), F.lit("Sin tipologia")).otherwise(
        F.coalesce(lookup(letters, fixed.DOCUMENT_TYPES), F.lit("Errado"))
    )


def base_type(campaign: ColumnLike) -> Column:
    name = text(campaign)
    return (
        F.when(name.isin("FLP 01", "FLP 02", "FLP 03"), F.concat(F.lit("CLIENTES "), name))
        .when(name == "Clientes Corporativos", F.lit("CLIENTES CORPORATIVOS"))
        .otherwise(F.lit("CLIENTES INVENTARIO"))
    )


def refinance_mark(refinanced: ColumnLike, *brand_marks: ColumnLike) -> Column:
    """Refinance mark, cleared when any brand mark is set."""
    any_mark = F.lit(False)
    for mark in brand_marks:
        any_mark = any_mark | F.coalesce(text(mark) == "Y", F.lit(False))
    return F.when(any_mark & (text(refinanced) == "Y"), F.lit("")).otherwise(text(refinanced))


def second_brand(city: ColumnLike, brand: ColumnLike) -> Column:
    return F.when(text(city) == fixed.MANUAL_CITY, F.lit(fixed.MANUAL_BRAND)).otherwise(text(brand))


def known_payment(payment: ColumnLike) -> Column:
    col = text(payment)
    return F.when(col.isNull() | (col == ""), F.lit("Sin Pago")).otherwise(col)


def known_ranking(status: ColumnLike) -> Column:
    col = text(status)
    return F.when(col.isNull() | (col == ""), F.lit(fixed.NO_RANKING)).otherwise(col)


def origin_label(origin: ColumnLike, kind: str) -> Column:
    """Product label of an origin in one of the label sets; unknown origins stay."""
    return F.coalesce(lookup(text(origin), fixed.ORIGIN_LABELS[kind]), text(origin))


def origin_state(origin: ColumnLike) -> Column:
    return F.when(text(origin) == "ASCARD", F.lit("bloqueo")).otherwise(F.lit("suspension"))


def box_code(origin: ColumnLike) -> Column:
    return F.coalesce(lookup(text(origin), fixed.BOX_CODES), F.lit(fixed.BOX_ERROR))


def keyword_group(
    name: ColumnLike,
    rules: Sequence[tuple[str, Sequence[str]]] = fixed.CAMPAIGN_KEYWORDS,
) -> Column:
    """Group of the last rule with a keyword in the name; the name itself when none fits."""
    lowered = F.lower(text(name))

    def holds(keywords: Sequence[str]) -> Column:
        found = F.lit(False)
        for keyword in keywords:
            found = found | lowered.contains(keyword)
        return found

    return first_match([(holds(words), F.lit(group)) for group, words in reversed(rules)], text(name))


def unified_group(
    name: ColumnLike,
    rules: Sequence[tuple[str, str]] = fixed.UNIFIED_GROUPS,
    own_name: str | None = None,
    own_source: Column | None = None,
    own_group: str | None = None,
) -> Column:
    """Second unification: the last matching pattern wins.

    ``own_name`` adds a rule that counts only where ``own_source`` holds; it ranks
    right after the first pattern.
    """
    lowered = F.lower(text(name))
    ordered = [(lowered.rlike(pattern), F.lit(group)) for pattern, group in rules]
    if own_name is not None:
        ordered.insert(1, (lowered.contains(own_name) & own_source, F.lit(own_group)))
    return first_match(ordered[::-1], text(name))


def profile_group(profile: ColumnLike) -> Column:
    """CDIR, CIND or NOC of a call profile; null when unknown."""
    return lookup(F.translate(F.lower(text(profile)), " ", ""), fixed.PROFILE_GROUPS)


def mix_label(direct: ColumnLike, indirect: ColumnLike, none: ColumnLike) -> Column:
    """Names of the contact groups with a positive count, '' when there is none."""

    def named(count: ColumnLike, name: str) -> Column:
        return F.when(number(count) > 0, F.lit(name))

    return F.concat_ws(" ", named(direct, "CDIR"), named(indirect, "CIND"), named(none, "NOC"))


def contact_profile(mobiles: ColumnLike, landlines: ColumnLike, emails: ColumnLike) -> Column:
    def named(count: ColumnLike, name: str) -> Column:
        return F.when(number(count) > 0, F.lit(name))

    label = F.concat_ws(" ", named(mobiles, "Celular"), named(landlines, "Fijo"), named(emails, "Email"))
    return F.when(label == "", F.lit("No posee Demograficos")).otherwise(label)


def shown_count(count: ColumnLike) -> Column:
    """Count as text, blank for zero or null."""
    return F.when(F.coalesce(number(count), F.lit(0.0)) == 0, F.lit("")).otherwise(text(count))


def dialer_text(status: ColumnLike, default: Column | None = None, predictive: bool = True) -> Column:
    table = {
        code: label
        for code, label in fixed.DIALER_TEXT.items()
        if predictive or code not in fixed.DIALER_ONLY_PREDICTIVE
    }
    return F.coalesce(lookup(text(status), table), F.lit("error") if default is None else default)


def dialer_profile(status: ColumnLike) -> Column:
    return F.coalesce(lookup(text(status), fixed.DIALER_PROFILE), F.lit("error"))


def dialer_effect(status: ColumnLike, account: ColumnLike) -> Column:
    code = text(status)
    return (
        F.when(F.length(text(account)) < 3, F.lit("Sin cuenta"))
        .when(code.isin(*fixed.DIALER_INEFFECTIVE), F.lit("No efectivo"))
        .when(code == fixed.DIALER_NOT_DIALED, F.lit("Sin marcar"))
        .otherwise(F.lit("Efectivo"))
    )


def bot_main_filter(disposition: ColumnLike, payment_answer: ColumnLike) -> Column:
    answer = text(payment_answer)
    return (
        F.when(answer.isin(*fixed.BOT_AGREED), F.lit("Compromiso de Pago con BOT"))
        .when(answer == fixed.BOT_PAID, F.lit("Cliente al dia"))
        .when(text(disposition) == "ANSWER", F.lit("Efectivo sin Compromiso de Pago"))
        .otherwise(F.lit("No efectivo"))
    )


def bot_typology(disposition: ColumnLike, identity_answer: ColumnLike, payment_answer: ColumnLike) -> Column:
    call, who, answer = text(disposition), text(identity_answer), text(payment_answer)
    answered = call == "ANSWER"
    holder = F.when(answer == fixed.BOT_PAID, F.lit("YA PAGO")).when(
        answer.isin(*fixed.BOT_AGREED), F.lit("PROMESA")
    )
    identity = lookup(who, fixed.BOT_IDENTITY)
    return first_match(
        [
            (call == "INVALID", F.lit("INVALIDO")),
            (call == "BUSY", F.lit("OCUPADO")),
            (answer.isin(*fixed.BOT_REFUSED), F.lit("RENUENTE")),
            (answered & (identity == "TITULAR"), F.coalesce(holder, F.lit("TITULAR"))),
            (answered & identity.isNotNull(), identity),
            (answered & who.isNull(), F.lit("CONTESTADO")),
        ],
        F.coalesce(lookup(call, fixed.BOT_UNANSWERED), F.lit("NO MARCADO")),
    )


def ranking_state(state: ColumnLike, kind: ColumnLike) -> Column:
    """Work state of a ranking row from its own state and its kind (fija or movil)."""
    key = F.upper(F.concat(text(state), text(kind)))
    collecting = F.lit(False)
    for mark in fixed.COLLECTION_MARKS:
        collecting = collecting | key.contains(mark)
    return F.coalesce(
        lookup(key, fixed.RANKING_STATES), F.when(collecting, F.lit(fixed.COLLECTION_STATE)), key
    )


def list_campaign(
    list_id: ColumnLike,
    known: Mapping[str, str] = fixed.LIST_CAMPAIGNS,
    default: str = fixed.DEFAULT_LIST_CAMPAIGN,
) -> Column:
    col = text(list_id)
    return F.coalesce(lookup(col, known), F.when(F.length(col) > 5, col), F.lit(default))


def dispatch_flag(name: ColumnLike, channel: ColumnLike, reference: ColumnLike) -> Column:
    adjust = (F.length(text(name)) < 4) | (text(channel) == "DELIMITAR") | (text(reference) == "SIN REFERENCIA")
    return F.when(adjust, F.lit("Ajustar antes de envio")).otherwise(F.lit("Limpio para envio"))


def bucket_label(bucket: ColumnLike) -> Column:
    """'MORA n' for numbers, upper-case text otherwise."""
    col = F.trim(text(bucket))
    digits = F.when(col.rlike("^[0-9]+$"), col)
    rounded = number(col).try_cast("bigint").cast("string")
    return F.coalesce(F.concat(F.lit("MORA "), F.coalesce(digits, rounded)), F.upper(col))


def touched_account(account: ColumnLike) -> Column:
    """Account without dashes; blank becomes '0'."""
    return F.when(is_blank(account), F.lit("0")).otherwise(F.translate(text(account), "-", ""))
