"""Column expressions that several operators share.

Text columns of sessions keep '' and '-' as values; safe_* give every
expression a value, whatever the input holds, so rules never meet a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IPV4 = r"^\s*(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\s*$"


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def safe_text(df: DataFrame, name: str) -> Column:
    """Lower-cased and trimmed; '' for a null or a missing column."""
    return F.lower(F.trim(raw_text(df, name)))


def raw_text(df: DataFrame, name: str) -> Column:
    return F.coalesce(df[name].cast("string"), F.lit("")) if has(df, name) else F.lit("")


def safe_number(df: DataFrame, name: str, default: float) -> Column:
    """The number in a text; the default where there is none."""
    return F.coalesce(df[name].cast("string").try_cast("double"), F.lit(float(default))) if has(df, name) else F.lit(float(default))


def safe_int(df: DataFrame, name: str, default: int) -> Column:
    """safe_number cut to its whole part."""
    return safe_number(df, name, default).cast("long")


def octet(address: Column, n: int) -> Column:
    """The n-th octet (from 1) of the first of comma-joined IPv4 addresses; null if that isn't one."""
    return F.regexp_extract(F.split_part(address, F.lit(","), F.lit(1)), IPV4, n).try_cast("int")


def loose_octet(address: Column, n: int) -> Column:
    """The n-th dot-separated part of a raw address as a number; null if it isn't one."""
    return F.get(F.split(address, r"\."), F.lit(n - 1)).try_cast("double")


def is_public(address: Column) -> Column:
    """Whether the first address is an IPv4 address of the Internet; false if it isn't IPv4."""
    a, b = octet(address, 1), octet(address, 2)
    private = a.isin(10, 127, 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (a >= 224)
    return F.coalesce(a.isNotNull() & ~private, F.lit(False))


def task_part(name: Column, n: int) -> Column:
    """The n-th of the first three parts of a class name at '_'; '-' where it is missing or empty."""
    return F.coalesce(F.nullif(F.get(F.split(name, "_"), F.lit(n - 1)), F.lit("")), F.lit("-"))


#: Protocol names by layer, and names that are no layer.
L2_TOKENS = ("eth", "ethernet", "ieee802", "ipnet", "linux_sll", "loop", "nflog", "null", "ppp", "raw", "sll", "sll2", "wlan")
L3_TOKENS = ("arp", "ip", "ipv6", "rarp")
L4_TOKENS = ("gre", "icmp", "icmpv6", "igmp", "sctp", "tcp", "udp")
SKIPPED_TOKENS = ("_ws.malformed", "data", "ethertype", "fc", "frame", "llc", "tcp.segments", "tls.segments", "vlan")


def layers(chain: Column) -> dict[str, Column]:
    """L2, L3, L4 and L7 of a protocol chain such as eth:ip:tcp:tls; '-' where a layer is missing."""
    tokens = F.split(chain, ":")

    def first(keep) -> Column:
        return F.try_element_at(F.filter(tokens, keep), F.lit(1))

    top = first(lambda t: ~t.isin(*L2_TOKENS, *L3_TOKENS, *L4_TOKENS, *SKIPPED_TOKENS) & (t != ""))
    inner = F.try_element_at(F.filter(tokens, lambda t: t.isin("smb", "smb2")), F.lit(1))
    top = F.when(top == "nbss", F.coalesce(inner, top)).otherwise(top)
    found = {"L2": first(lambda t: t.isin(*L2_TOKENS)), "L3": first(lambda t: t.isin(*L3_TOKENS)), "L4": first(lambda t: t.isin(*L4_TOKENS)), "L7": top}
    return {name: F.coalesce(column, F.lit("-")) for name, column in found.items()}


def microseconds(seconds: Column) -> Column:
    """Decimal seconds as whole microseconds, halves to even; null for '-' and other text."""
    return F.bround(seconds.cast("string").try_cast("decimal(30,9)") * F.lit(1_000_000).cast("decimal(10,0)"), 0).cast("long")


def plain_port(port: Column) -> Column:
    """443.0 and 443 alike as text; '-' and other text as they are."""
    return F.coalesce(port.cast("string").try_cast("double").cast("long").cast("string"), port.cast("string"))


def content_key(l4: Column, src: Column, sport: Column, dst: Column, dport: Column, seconds: Column) -> Column:
    """16 hex digits that name a session by its content, whichever end comes first."""
    a, b = (F.concat_ws(":", ip, plain_port(port)) for ip, port in ((src, sport), (dst, dport)))
    stamp = F.coalesce(microseconds(seconds).cast("string"), F.lit("-"))
    return F.substring(F.sha1(F.concat_ws("|", l4, F.least(a, b), F.greatest(a, b), stamp)), 1, 16)


def hash_fraction(*parts: Column) -> Column:
    """crc32 of the parts joined by '|', as a fraction of its greatest value."""
    return F.crc32(F.concat_ws("|", *[p.cast("string") for p in parts])) / F.lit(4294967295.0)


def split_role(seed: int, filename: Column, session: Column, ratio: float = 0.2) -> Column:
    """test or train, by identity alone: a session has one role in every list."""
    return F.when(hash_fraction(F.lit(str(seed)), filename, session) < ratio, "test").otherwise("train")


def session_parts(session: Column) -> tuple[Column, Column]:
    """(proto, stream) of an id such as tcp_12; ('-', '-') without a '_'."""
    parts = F.split(session, "_", 2)
    split = F.size(parts) == 2
    return F.when(split, parts[0]).otherwise("-"), F.when(split, F.get(parts, F.lit(1))).otherwise("-")


def natural_key(text: Column, width: int = 12) -> Column:
    """Text that sorts by its runs of digits as numbers: each padded with zeros."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def group_key(task: str) -> Column:
    """A session's class: one of task1, task2 and task3, or for ``full`` all three joined by '_'."""
    return F.concat_ws("_", "task1", "task2", "task3") if task == "full" else F.col(task)


def listed_order(value: Column, order: list[str]) -> tuple[Column, Column]:
    """Sort keys: the place of a value in a list, case ignored, others behind; then the value without its case."""
    low = F.lower(value)
    place = F.array_position(F.array(*[F.lit(x.lower()) for x in order]), low) if order else F.lit(0)
    return F.when(place > 0, place).otherwise(len(order) + 1), low


def loose_session(session: Column) -> Column:
    """What names a session in a list of wrong answers: an id with letters itself, any other by its first run of digits."""
    return F.when(session.rlike("[a-zA-Z]"), F.concat(F.lit("id:"), session)).otherwise(F.concat(F.lit("n:"), F.regexp_extract(session, r"\d+", 0)))
