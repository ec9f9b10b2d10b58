"""Host names of web addresses in normal form, in JVM functions only.

Names are percent-decoded and turned to ASCII (punycode); names that end in a number are IPv4 addresses in any of the
forms that the C library reads (``127.1``, ``0x7f.1``, ``017700000001``); IPv6 addresses get their shortest form."""

from __future__ import annotations

from creatorlake.functions.sql import let, matches

_NAME = r"\A[a-z0-9!\"$&\x27()*+,;=_.~{}`-]+\z"
_ENDS_IN_NUMBER = r"(\A|\.)([0-9]+|0x[0-9a-f]*)\.?\z"
# Most names: nothing to decode or fold, and no number at the end.
_PLAIN = r"\A(?!.*[xX][nN]--)([a-zA-Z0-9_-]+\.)*[a-zA-Z][a-zA-Z0-9_-]*\z"
_ASCII = r"\A[\x00-\x7f]*\z"
# Letters that the versions of the standard turn into ASCII in different ways, and ignored marks.
_DISPUTED = r"[ßẞς\u200c\u200d]"
_IGNORED = r"[\u00ad\u200b\u2060\ufeff\ufe00-\ufe0f]"
_GROUP = r"\A[0-9a-f]{1,4}\z"
_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DOTTED = rf"\A{_BYTE}(\.{_BYTE}){{3}}\z"
_NUMBERS = "array<decimal(20,0)>"


def _decoded(host: str) -> str:
    """Percent signs resolved; NULL where they stand for no UTF-8."""
    return f"if(contains({host}, '%'), try_url_decode(replace({host}, '+', '%2B')), {host})"


def _ascii(host: str) -> str:
    """Lower-case ASCII form; NULL for names the standard rejects and for those with disputed letters."""
    # Compatibility forms, letter case and full stops of other scripts are folded by the same function.
    international = f"try_reflect('java.net.IDN', 'toASCII', regexp_replace({host}, '{_IGNORED}', ''), 1)"
    return f"""CASE WHEN {matches(host, _ASCII)} THEN lower({host})
        WHEN {host} rlike '{_DISPUTED}' THEN NULL ELSE lower({international}) END"""


def _number(part: str) -> str:
    """One part of an IPv4 address, decimal, octal (0...) or hexadecimal (0x...); NULL if it is none or too large."""
    digits = f"ltrim('0', if({part} rlike '^0x', substr({part}, 3), {part}))"
    return let("__d", digits, f"""CAST(CASE WHEN length(__d) > 16 OR {part} = '' THEN NULL WHEN __d = '' AND {part} rlike '^(0x)?0*$' THEN '0'
        WHEN {part} rlike '^0x[0-9a-f]+$' THEN if(length(__d) > 8, NULL, conv(__d, 16, 10))
        WHEN {part} rlike '^0[0-7]+$' THEN if(length(__d) > 11, NULL, conv(__d, 8, 10))
        WHEN {part} rlike '^[1-9][0-9]*$' THEN __d END AS DECIMAL(20, 0))""")


def _ipv4(host: str) -> str:
    """Dotted form; NULL for a name that ends in a number but is no address. The last part fills what is left."""
    parts = f"split(regexp_replace({host}, '[.]$', ''), '[.]')"
    numbers = f"transform({parts}, __p -> {_number('__p')})"
    whole = """aggregate(slice(__n, 1, size(__n) - 1), named_struct('at', 3, 'sum', CAST(element_at(__n, -1) AS BIGINT)),
        (__a, __x) -> named_struct('at', __a.at - 1, 'sum', __a.sum + CAST(__x AS BIGINT) * CAST(pow(256, __a.at) AS BIGINT)), __a -> __a.sum)"""
    dotted = "concat_ws('.', transform(array(24, 16, 8, 0), __s -> CAST(shiftright(__w, __s) & 255 AS STRING)))"
    fits = """size(__n) <= 4 AND NOT exists(__n, __x -> __x IS NULL) AND NOT exists(slice(__n, 1, size(__n) - 1), __x -> __x > 255)
        AND element_at(__n, -1) < CAST(pow(256, 5 - size(__n)) AS BIGINT)"""
    return let("__n", numbers, f"if({fits}, {let('__w', whole, dotted)}, NULL)")


def _groups(text: str) -> str:
    """Groups of one side of ``::``, a dotted end as two groups; the empty text has none. Bad groups stay as they are."""
    last = f"element_at(split({text}, ':'), -1)"
    four = "transform(split(__l, '[.]'), __x -> CAST(__x AS INT))"
    pair = f"""transform(array({four}), __f -> array(lower(hex(__f[0] * 256 + __f[1])), lower(hex(__f[2] * 256 + __f[3]))))[0]"""
    dotted = let("__l", last, f"if({matches('__l', _DOTTED)}, {pair}, array(__l))")
    return f"if({text} = '', CAST(array() AS ARRAY<STRING>), concat(slice(split({text}, ':'), 1, size(split({text}, ':')) - 1), {dotted}))"


def _ipv6(host: str) -> str:
    """``[...]`` in its shortest form: no leading zeros, the first longest run of zero groups as ``::``; NULL if it is no address."""
    inside = f"substr({host}, 2, length({host}) - 2)"
    halves = f"split({inside}, '::', -1)"
    filled = f"""transform(array(named_struct('left', {_groups('__h[0]')}, 'right', if(size(__h) = 2, {_groups('__h[1]')}, CAST(array() AS ARRAY<STRING>)))),
        __b -> if(size(__h) = 2 AND size(__b.left) + size(__b.right) <= 7,
            concat(__b.left, array_repeat('0', 8 - size(__b.left) - size(__b.right)), __b.right), __b.left))[0]"""
    plain = "transform(__g, __x -> coalesce(nullif(ltrim('0', __x), ''), '0'))"
    flags = "array_join(transform(__z, __x -> if(__x = '0', '0', 'x')), '')"
    run = "get(filter(transform(sequence(8, 2), __k -> named_struct('n', __k, 'at', instr(__f, repeat('0', __k)))), __q -> __q.at > 0), 0)"
    short = """if(__r IS NULL, array_join(__z, ':'),
        concat(array_join(slice(__z, 1, __r.at - 1), ':'), '::', array_join(slice(__z, __r.at + __r.n, 8), ':')))"""
    shortest = let("__z", plain, let("__f", flags, let("__r", run, short)))
    fits = f"size(__g) = 8 AND forall(__g, __x -> {matches('__x', _GROUP)})"
    body = let("__g", filled, f"if({fits}, concat('[', {shortest}, ']'), NULL)")
    return let("__h", halves, f"if(size(__h) <= 2, {body}, NULL)")


def normalize_host(host: str) -> str:
    """Host of an address as written, in normal form, or NULL if it is none.

    The rule on mixed writing directions is not checked."""
    broken = "exists(split(__t, '[.]'), __x -> startswith(__x, 'xn--') AND try_reflect('java.net.IDN', 'toUnicode', __x, 1) = __x)"
    name = f"""CASE WHEN {matches('__t', _ENDS_IN_NUMBER)} THEN {_ipv4('__t')}
        WHEN {matches('__t', _NAME)} AND NOT (contains(__t, 'xn--') AND {broken}) THEN __t END"""
    other = f"""if(startswith(__i, '['), if(endswith(__i, ']'), {let('__v', 'lower(__i)', _ipv6('__v'))}, NULL),
        {let('__o', _decoded('__i'), let('__t', _ascii('__o'), name))})"""
    return let("__i", host, f"CASE WHEN {matches('__i', _PLAIN)} THEN lower(__i) ELSE {other} END")
