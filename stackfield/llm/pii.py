"""Surrogates for personal data.

Addresses, phone and card numbers, IP addresses of both kinds, social security and bank
account numbers and names are detected and replaced. A surrogate is a keyed
permutation of the entity within its type and format: each letter or digit moves
within its class (vowels, consonants, digits; small and capital letters of each
other script by themselves; case kept)
by a step that depends on the key and on what stands before it, once forwards
and once backwards; other characters stay. Different entities of a type thus
have different surrogates, and the same entity has the same one wherever it
stands and however it is spaced or capitalised. Known given names move within
the list of their gender and script. A check over all entities finds surrogates
that two entities share or that some text has as an entity of its own, and these
get another key; those that clash under every key (a format all of whose values
are taken) get a keyed digest in the place of a surrogate. DataFrame functions only; the surrogates of a row are made in
the row, so texts are not shuffled.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, shuffle_partitions

# Given names by gender and script, and titles.
NAMES = {
    "latin_f": "Aisha Alice Amy Ana Anna Barbara Carmen Charlotte Chloe Claire Deepa Elena Elizabeth Emily Emma Fatima Hannah Ingrid Isabel Jane Jennifer Jessica Julia Karin Kate Katarzyna Laura Linda Lisa Lucia Maria Marie Mary Mei Nicole Olga Olivia Patricia Priya Sabine Sarah Sofia Sophie Susan Ursula Yuki".split(),
    "latin_m": "Abdul Ahmed Alan Alexander Ali Andreas Andrew Antonio Arjun Brian Carlos Charles Daniel David Edward Frank George Hans Henry Hiroshi Ivan Jack James Jean John Jose José Juan Karl Kevin Louis Luis Manuel Mark Matthew Michael Miguel Mohammed Omar Paul Pedro Peter Pierre Raj Richard Robert Thomas Wei William".split(),
    "cyrillic_f": "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    "cyrillic_m": "Александр Алексей Андрей Дмитрий Иван Михаил Николай Сергей".split(),
    "greek_f": "Αικατερίνη Βασιλική Ελένη Μαρία Σοφία".split(),
    "greek_m": "Γεώργιος Δημήτρης Ιωάννης Κωνσταντίνος Νικόλαος".split(),
}
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra"
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåèêëéìîïíòôöóõùûüúœæ", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ")

_ALL_NAMES = [n for names in NAMES.values() for n in names]
#: A part of a name: O'Neil, McDonald and García-Jones too.
_WORD = r"\p{Lu}(?:['’]\p{Lu}|a?c\p{Lu})?[\p{Ll}’']*\p{Ll}(?:-\p{Lu}[\p{Ll}’']*\p{Ll})?"
_CAPITALS = r"\p{Lu}(?:['’]\p{Lu})?\p{Lu}+(?:-\p{Lu}{2,})?"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
#: Eight groups, or fewer around one gap; the first has a digit.
IPV6 = r"(?<![0-9A-Za-z:.])(?=[A-Fa-f]{0,3}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
CARD = r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])|(?<![0-9.-])00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,5}(?![0-9])|(?<=(?i:phone|tel|call|fax|mobile|cell)[a-z]{0,4}[.:]{0,2}[ ]{0,2})[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
NAME = rf"\b(?:(?:{TITLES})\.? {_WORD}(?: {_WORD})?|(?:{'|'.join(sorted(_ALL_NAMES, key=len, reverse=True))}) {_WORD}|(?:{'|'.join(sorted(map(str.upper, _ALL_NAMES), key=len, reverse=True))}) {_CAPITALS}\b)"
#: What a position begins with decides which patterns are tried there.
_NUMBERS = rf"(?=[0-9+(])(?:{'|'.join((IPV4, CARD, SSN, PHONE))})"
_NAMED = rf"(?=\p{{Lu}})(?:{NAME})"
_CAPITAL = rf"(?=\p{{Lu}})(?:{IBAN}|{NAME})"
#: Of texts with @, of others with digits, of all others; the first finds all of them.
ENTITY = f"{EMAIL}|{IPV6}|{_NUMBERS}|{_CAPITAL}"
_NO_EMAIL, _NO_DIGITS = f"{IPV6}|{_NUMBERS}|{_CAPITAL}", _NAMED
#: Entities with another key that are named in the plan, at most; more of them are joined to the texts.
EXCEPTIONS = 5000
#: Keys that are tried; an entity that clashes under all of them gets a digest.
TURNS = 8


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _step(seed: str, n: str) -> str:
    """1 to n - 1 by the key: never 0, so that every character changes; 0 where n is 1."""
    return f"if({n} < 2, 0, 1 + cast(conv(substring(sha2({seed}, 256), 1, 12), 16, 10) as bigint) % greatest({n} - 1, 1))"


#: The classes, small and capital letters apart (capitals only where each letter has one).
_LETTERS = [*dict.fromkeys(x for a in CLASSES for x in (a, a.upper() if len(a.upper()) == len(a) else a)), "0123456789"]


def _other_letters() -> list[str]:
    """The small and the capital letters of each further script, and those that CLASSES leaves out of its own."""
    known, by = set("".join(_LETTERS)), {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if c not in known and (kind := unicodedata.category(c)) in ("Lu", "Ll"):
            by.setdefault((unicodedata.name(c).split()[0], kind), []).append(c)
    alone = {kind: "".join(x[0] for (_, k), x in by.items() if k == kind and len(x) == 1) for kind in ("Lu", "Ll")}
    return ["".join(x) for x in by.values() if len(x) > 1] + [x for x in alone.values() if len(x) > 1]


_ASCII = f"split({_q(' '.join(x for x in _LETTERS if x.isascii()))}, ' ')"
_ALL = f"split({_q(' '.join([*_LETTERS, *_other_letters()]))}, ' ')"
_CLASSES = f"if(ascii(c) < 128, {_ASCII}, {_ALL})"


def _pass(s: str, key: str, classes: str = _CLASSES) -> str:
    """The characters of s, each moved within its class by the key and what stands before it; others stay."""
    step = _step(f"concat({key}, a.p)", "length(z)")
    moved = f"transform(filter({classes}, z -> c <> '' AND instr(z, c) > 0), z -> named_struct('o', substring(z, cast((instr(z, c) - 1 + {step}) % length(z) + 1 as int), 1), 'p', lower(c)))"
    return f"aggregate(split({s}, ''), named_struct('o', '', 'p', ''), (a, c) -> transform(array(get({moved}, 0)), m -> named_struct('o', concat(a.o, coalesce(m.o, c)), 'p', concat(a.p, coalesce(m.p, ''))))[0], a -> a.o)"


def permuted(s: str, key: str, classes: str = _CLASSES) -> str:
    """SQL of the keyed permutation of the string s, forwards and backwards."""
    forward = _pass(s, f"concat({key}, '>')", classes)
    return f"reverse({_pass(f'reverse({forward})', f'concat({key}, {_q(chr(60))})', classes)})"


def _ipv6(e: str, key: str) -> str:
    """Each hexadecimal digit moves; in capitals if the address has any."""
    moved = permuted(f"lower({e})", key, "array('0123456789abcdef')")
    return f"if({e} rlike '[A-F]', upper({moved}), {moved})"


def _luhn(digits: str) -> str:
    """The check digit of a string of digits without it."""
    d = f"cast(substring({digits}, -i, 1) as int)"
    twice = f"if(i % 2 = 1, if(2 * {d} > 9, 2 * {d} - 9, 2 * {d}), {d})"
    return f"((10 - aggregate(sequence(1, length({digits})), 0, (t, i) -> t + {twice}) % 10) % 10)"


def _refilled(form: str, digits: str) -> str:
    """The digits, in the places that form has digits in."""
    return f"aggregate(split({form}, ''), named_struct('o', '', 'n', 1), (a, c) -> if(c between '0' and '9', named_struct('o', concat(a.o, substring({digits}, a.n, 1)), 'n', a.n + 1), named_struct('o', concat(a.o, c), 'n', a.n)), a -> a.o)"


def _card(e: str, key: str) -> str:
    old = f"regexp_replace({e}, '[^0-9]', '')"
    body = f"transform(array({old}), cd -> named_struct('d', cd, 'b', concat(substring(cd, 1, 1), {permuted('substring(cd, 2, length(cd) - 2)', key)})))[0]"
    check = f"(cast(substring(cx.d, -1, 1) as int) - {_luhn('substring(cx.d, 1, length(cx.d) - 1)')} + {_luhn('cx.b')} + 10) % 10"
    return f"transform(array({body}), cx -> {_refilled(e, f'concat(cx.b, cast({check} as string))')})[0]"


#: First octets of public networks whose other octets are all public too.
_PUBLIC = [o for o in range(1, 224) if o not in (10, 100, 127, 169, 172, 192, 198, 203)]


def _ipv4(e: str, key: str) -> str:
    """Octets that mark a special network stay; each later one moves by a step
    that depends on those before it."""
    o = f"transform(split({e}, '[.]'), oc -> cast(oc as int))"
    public = ",".join(map(str, _PUBLIC))
    keep = "CASE WHEN o[0] IN (" + public + ") THEN 0 WHEN o[0] IN (100, 169, 172, 192, 198, 203) THEN 2 ELSE 1 END"
    first = f"cast(split('{public}', ',')[cast((array_position(cast(split('{public}', ',') as array<int>), o[0]) - 1 + {_step(f'concat({key}, o[0] - o[0])', str(len(_PUBLIC)))}) % {len(_PUBLIC)} as int)] as int)"
    moved = f"cast((o[i] + {_step(f'concat({key}, array_join(slice(o, 1, i), {_q(chr(46))}))', '256')}) % 256 as int)"
    return f"transform(array({o}), o -> array_join(transform(sequence(0, 3), i -> if(i < {keep}, o[i], if(i = 0, {first}, {moved}))), '.'))[0]"


def _person(e: str, key: str) -> str:
    """Titles stay, known given names move within their list, other names letter by letter; words in capitals stay so."""
    whens = [f"WHEN w rlike '^({TITLES})[.]?$' THEN w"]
    plain = "if(length(w) > 2 AND w = upper(w), initcap(lower(w)), w)"
    for group, names in NAMES.items():
        array = f"array({', '.join(map(_q, names))})"
        moved = f"{array}[cast((array_position({array}, {plain}) - 1 + {_step(f'concat({key}, {_q(group)})', str(len(names)))}) % {len(names)} as int)]"
        whens.append(f"WHEN array_contains({array}, {plain}) THEN if(length(w) > 2 AND w = upper(w), upper({moved}), {moved})")
    return f"array_join(transform(split({e}, ' '), w -> CASE {' '.join(whens)} ELSE {permuted('w', key)} END), ' ')"


def kind_sql(e: str) -> str:
    tests = (("email", "@"), ("ipv6", "^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$"), ("ipv4", rf"^(?:{OCTET}\.){{3}}{OCTET}$"), ("card", r"^(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})$"), ("iban", r"^[A-Z]{2}[0-9]{2}"), ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("phone", r"^[+(0-9]"))
    return "CASE " + " ".join(f"WHEN {e} rlike {_q(p)} THEN '{k}'" for k, p in tests) + " ELSE 'name' END"


def norm_sql(e: str, kind: str) -> str:
    """What makes two entities of a kind the same."""
    return f"concat({kind}, ':', CASE {kind} WHEN 'email' THEN lower({e}) WHEN 'ipv6' THEN lower({e}) WHEN 'ipv4' THEN {e} WHEN 'name' THEN lower(regexp_replace({e}, {_q(f'^(?:{TITLES})[.]? ')}, '')) WHEN 'iban' THEN regexp_replace({e}, ' ', '') WHEN 'phone' THEN right(regexp_replace({e}, '[^0-9]', ''), 10) ELSE regexp_replace({e}, '[^0-9]', '') END)"


def surrogate_sql(e: str, kind: str, key: str) -> str:
    email = f"concat({permuted(f'substring_index({e}, {_q(chr(64))}, 1)', key)}, '@', {permuted(f'regexp_extract({e}, {_q("@(.*)[.][A-Za-z]+$")}, 1)', key)}, regexp_extract({e}, {_q('([.][A-Za-z]+)$')}, 1))"
    tail = r"^(.*?)((?:[^0-9]*[0-9]){1,10})$"
    phone = f"concat(regexp_extract({e}, {_q(tail)}, 1), {permuted(f'regexp_extract({e}, {_q(tail)}, 2)', key)})"
    iban = f"concat(substring({e}, 1, 2), {permuted(f'substring({e}, 3)', key)})"
    return f"CASE {kind} WHEN 'email' THEN {email} WHEN 'ipv6' THEN {_ipv6(e, key)} WHEN 'ipv4' THEN {_ipv4(e, key)} WHEN 'card' THEN {_card(e, key)} WHEN 'phone' THEN {phone} WHEN 'iban' THEN {iban} WHEN 'name' THEN {_person(e, key)} ELSE {permuted(e, key)} END"


def _new(secret: str, x: str) -> str:
    """What stands in the place of the entity x (e, kind, norm, turn): turn, where it is not null, changes the key."""
    key = f"concat({_q(secret)}, {x}.kind, coalesce(concat('#', {x}.turn), ''))"
    digest = f"concat('[', {x}.kind, ' ', substring(sha2(concat({_q(secret)}, {x}.norm), 256), 1, 24), ']')"
    return f"if(coalesce({x}.turn, 0) > {TURNS}, {digest}, {surrogate_sql(f'{x}.e', f'{x}.kind', key)})"


def found_sql(text: str) -> str:
    """The entities of text, by the smallest pattern that can find them all."""
    by = lambda p: f"regexp_extract_all({text}, {_q(p)}, 0)"
    return f"CASE WHEN contains({text}, '@') THEN {by(ENTITY)} WHEN {text} rlike '[0-9]' THEN {by(_NO_EMAIL)} ELSE {by(_NO_DIGITS)} END"


def _normed(entities: str) -> str:
    """SQL of the array of (e, kind, norm) of an array of entities."""
    found = f"transform({entities}, e -> named_struct('e', e, 'kind', {kind_sql('e')}))"
    return f"transform({found}, x -> named_struct('e', x.e, 'kind', x.kind, 'norm', {norm_sql('x.e', 'x.kind')}))"


def _entities(entities: str, secret: str, turn: Callable[[str], str]) -> str:
    """SQL of the array of (e, kind, norm, new) of an array of entities; turn gives the SQL of the turn of a norm."""
    turned = f"transform({_normed(entities)}, x -> named_struct('e', x.e, 'kind', x.kind, 'norm', x.norm, 'turn', {turn('x.norm')}))"
    return f"transform({turned}, x -> named_struct('e', x.e, 'kind', x.kind, 'norm', x.norm, 'new', {_new(secret, 'x')}))"


def _first_key(norm: str) -> str:
    return "cast(null as int)"


def clashes(entities: DataFrame) -> DataFrame:
    """(norm) of the entities (norm, new_norm) to be given another key: of those
    that share a surrogate all but the first, and those whose surrogate some
    text has as an entity; none of none."""
    shared = entities.groupBy("new_norm").agg(F.count("*").alias("n"), F.min("norm").alias("first")).filter("n > 1")
    twice = entities.join(shared, "new_norm").filter("norm <> first").select("norm")
    real = entities.join(entities.select(F.col("norm").alias("real")), F.col("new_norm") == F.col("real"), "left_semi").select("norm")
    return twice.union(real).distinct()


def find_exceptions(rows: DataFrame, secret: str) -> DataFrame | None:
    """(norm, turn) of the entities of rows (text) that need another key, and
    which; a turn above TURNS is a digest. None if there are none, as for rows
    without entities. The other tables that it writes, with entities as they
    are, are removed; this one is when the caller discards it."""
    exceptions = None
    found = rows.select(F.explode(F.expr(found_sql("text"))).alias("e")).groupBy("e").count().select("e")
    kept = saved(found.select("e", F.expr(_normed("array(e)"))[0]["norm"].alias("norm")), "entities")
    spread = kept.repartition(shuffle_partitions(rows.sparkSession))  # surrogates cost more than what it takes to deal them evenly
    for turn in range(1, TURNS + 1):
        turned = spread if exceptions is None else spread.join(exceptions, "norm", "left")
        each = turned.select(F.expr(_entities("array(e)", secret, _first_key if exceptions is None else lambda norm: "turn"))[0].alias("x")).select("x.norm", F.expr(norm_sql("x.new", "x.kind")).alias("new_norm"))
        made = saved(each.distinct(), "surrogates")
        again = saved(clashes(made), "clashes")
        discard(made)
        if again.isEmpty():
            discard(again)
            break
        turns = again.withColumn("turn", F.lit(turn if turn < TURNS else TURNS + 1))
        old, exceptions = exceptions, saved(turns if exceptions is None else exceptions.join(turns, "norm", "left_anti").unionByName(turns), "exceptions")
        discard(again, *([old] if old else []))
    discard(kept)
    return exceptions


def _with_turns(rows: DataFrame, exceptions: DataFrame) -> DataFrame:
    """rows with __turns, a map from the norms among its entities that are exceptions to their turns."""
    rows = saved(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    norms = rows.select("__row", F.explode(F.array_distinct(F.transform(F.expr(_normed(found_sql("text"))), lambda x: x["norm"]))).alias("norm"))
    turns = norms.join(exceptions, "norm").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("norm", "turn"))).alias("__turns"))  # of one text
    return rows.join(turns, "__row", "left")


def surrogates(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text with surrogates in the places of
    entities, n_entities, and kinds, the kinds of entities in it, sorted.

    A null text stays null; an empty text, and one without entities, stays as it
    is; equal texts have equal results; an empty table gives no rows; further
    columns are ignored. Letters without case stay as they are.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    exceptions, turn = find_exceptions(rows, secret), _first_key
    if exceptions is not None and len(few := exceptions.limit(EXCEPTIONS + 1).collect()) <= EXCEPTIONS:
        discard(exceptions)
        by = {t: ", ".join(_q(r["norm"]) for r in few if r["turn"] == t) for t in sorted({r["turn"] for r in few})}
        turn = lambda norm: f"CASE {' '.join(f'WHEN {norm} IN ({norms}) THEN {t}' for t, norms in by.items())} END"
    elif exceptions is not None:
        rows, turn = _with_turns(rows, exceptions), lambda norm: f"try_element_at(__turns, {norm})"
    out = rows.withColumn("x", F.expr(_entities(found_sql("text"), secret, turn)))
    joined = F.expr(f"array_join(zip_with(split(text, {_q(ENTITY)}, -1), transform(x, y -> y.new), (p, n) -> concat(p, coalesce(n, ''))), '')")
    n = F.greatest(F.size("x"), F.lit(0))
    return out.select("doc_id", F.when(n > 0, joined).otherwise(F.col("text")).alias("text"), n.cast("long").alias("n_entities"), F.coalesce(F.array_sort(F.array_distinct(F.transform("x", lambda y: y["kind"]))), F.array().cast("array<string>")).alias("kinds"))
