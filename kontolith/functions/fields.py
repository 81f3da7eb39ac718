"""Fields of a booking's purpose: type code, references, contract numbers, payee, keys, cadence names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontolith import schemas as S
from kontolith.functions import patterns as P


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(squeezed(text), " "), lambda w: w != "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def booking_type(purpose: Column) -> Column:
    """Type code by the purpose's beginning after up to two dates."""
    z = F.lower(F.trim(F.regexp_replace(F.coalesce(purpose, F.lit("")), P.LEADING_DATES, "")))
    out = F.when(F.lit(False), "")
    for prefix, code in P.KINDS:
        out = out.when(F.startswith(z, F.lit(prefix)), code)
    return out.otherwise("SONST")


def captured(purpose: Column, key: str) -> Column:
    """What follows ``key:`` up to the next marker or the end."""
    return squeezed(F.regexp_extract(purpose, rf"(?iusU)\b{key}[:\s]+(.*?)(?=\s+(?:{P.MARKERS})[:\s]|$)", 1))


def before_markers(purpose: Column) -> Column:
    return F.regexp_extract(purpose, rf"(?ius)^(.*?)(?:(?:{P.MARKERS})[:\s]|\z)", 1)


def contract_numbers(text: Column) -> Column:
    """Contract and customer numbers, by pattern and then by place, each once, joined by ``; ``."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in P.CONTRACTS))
    return F.array_join(F.array_distinct(F.transform(found, squeezed)), "; ")


def payee_core(purpose: Column) -> Column:
    """The payee in its own spelling: no prefix, note, references, tokens with digits or odd characters."""
    s = F.regexp_replace(F.regexp_replace(purpose, P.KIND_PREFIX, ""), P.PAYMENT_NOTE, "")
    ends = "|".join(rf"\Q{m}\E" for m in P.PAYEE_ENDS)
    s = F.regexp_extract(s, rf"(?ius)^(.*?)(?:{ends}|\z)", 1)
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\b\S*\d\S*\b", " "), r"(?U)[^\wäöüÄÖÜß .&-]", " ")
    return F.btrim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(" .-&"))


def payee_key(purpose: Column) -> Column:
    """First three words of the core, lower case, of at least two characters."""
    return F.array_join(F.slice(F.filter(F.split(F.lower(payee_core(purpose)), "[ .&-]+"), lambda w: F.length(w) >= 2), 1, 3), " ")


def payee_name(purpose: Column) -> Column:
    """First four words of the core; else the purpose's first 30 characters; else ?."""
    short = F.substring(F.trim(purpose), 1, 30)
    name = first_words(payee_core(purpose), 4)
    return F.when(name != "", name).when(short != "", short).otherwise("?")


def group_key(purpose: Column) -> Column:
    """Key of fixed costs: first four words of over two letters without digits; else the first 20 characters."""
    t = F.regexp_replace(F.regexp_replace(F.lower(purpose), r"(?U)\d+", " "), "[^a-zäöüß ]", " ")
    key = F.array_join(F.slice(F.filter(F.split(t, " +"), lambda w: F.length(w) > 2), 1, 4), " ")
    return F.when(key != "", key).otherwise(F.substring(F.lower(F.trim(purpose)), 1, 20))


def booking_fields(purpose: Column) -> dict[str, Column]:
    """``empfaenger, referenz, mandatsref, glaeubiger_id, vertragsnr`` of a purpose."""
    z = F.coalesce(purpose, F.lit(""))
    front = before_markers(z)
    numbers = contract_numbers(front)
    clean = F.aggregate(F.filter(F.split(numbers, "; "), lambda v: v != ""), front, lambda acc, v: F.replace(acc, v, F.lit(" ")))
    core = payee_core(clean)
    return {"empfaenger": F.when(core != "", core).otherwise("?"), "referenz": captured(z, "EREF"), "mandatsref": captured(z, "MREF"), "glaeubiger_id": captured(z, "CRED"), "vertragsnr": numbers}


def booking_kind(category: Column, amount: Column) -> Column:
    return F.when(category == S.TRANSFER, S.TRANSFER_KIND).when(amount >= 0, S.INCOME).otherwise(S.EXPENSE)


def reference_key(mandate: Column, contract: Column) -> Column:
    """Letters and digits of the mandate reference, else of the contract number, of at least five; else null."""
    norm = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]", "")
    pick = lambda c: F.when(F.length(norm(c)) >= 5, norm(c))
    return F.coalesce(pick(mandate), pick(contract))


def cadence_name(days: Column) -> Column:
    """The interval name that is nearest by relative deviation, at most 0.35; the shorter one on ties."""
    out = F.array(*(F.struct((F.abs(days - d) / d).alias("dev"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (d, name) in enumerate(P.CADENCES)))
    best = F.array_min(out)
    return F.when(days.isNotNull() & (best["dev"] <= 0.35), best["name"]).otherwise(P.IRREGULAR)


def cadence_text(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in P.CADENCE_TEXTS.items():
        out = out.when(name == k, v)
    return out.otherwise("")


def account_or_unknown(account: Column) -> Column:
    return F.coalesce(F.when(F.trim(account) != "", account), F.lit(S.UNKNOWN_ACCOUNT))


def last_four(account: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(account, F.lit("")), r"\s", "")
    return F.when(bare == "", "0000").otherwise(F.right(bare, F.lit(4)))


def account_label(account: Column, masked: bool) -> Column:
    return F.concat(F.lit("****"), last_four(account)) if masked else account_or_unknown(account)
