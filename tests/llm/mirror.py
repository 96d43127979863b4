"""The pseudonyms a second time, in plain Python."""

import datetime
import re
from hashlib import sha256

CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "44", "49", "351", "353")


def keystream(key, kind, i, half):
    return sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()


def text(t, key, kind, hexadecimal=False):
    a, b = t[: len(t) // 2], t[len(t) // 2 :]
    for i in range(1, 9):
        s, out = keystream(key, kind, i, b), ""
        for k, c in enumerate(a):
            move = int(s[2 * (k % 32) : 2 * (k % 32) + 2], 16)
            if hexadecimal:
                new = f"{(int(c, 16) + move) % 16:x}"
                out += new.upper() if re.search("[A-F]", a) else new
            else:
                first = "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else None
                out += c if first is None else chr(ord(first) + (ord(c) - ord(first) + move) % (10 if first == "0" else 26))
        a, b = b, out
    return a + b


def number(v, a, b, key, kind):
    x, y, m, n = v // b, v % b, a, b
    for i in range(1, 9):
        f = int(keystream(key, kind, i, str(y))[:12], 16)
        x, y, m, n = y, (x + f) % m, n, m
    return x * b + y


def into(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def digits(t):
    return re.sub(r"\D", "", t)


def luhn_digit(body):
    s = sum(v if i % 2 else v * 2 - 9 * (v > 4) for i, v in enumerate(int(c) for c in reversed(body)))
    return str(-s % 10)


def card(t, key):
    body = text(digits(t)[:-1], key, "card")
    return into(t, body + luhn_digit(body))


def phone(t, key):
    d = digits(t)
    n = max((len(c) for c in CODES if d.startswith(c)), default=0) if t[0] == "+" else 0
    return into(t, d[:n] + text(d[n:], key, "phone"))


def email(t, key):
    local, rest = t.split("@")
    return f"{text(local, key, 'email')}@{rest}"


def ipv4(t, key):
    v = 0
    for x in t.split("."):
        v = v * 256 + int(x)
    n = number(v, 1 << 16, 1 << 16, key, "ipv4")
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def ipv6(t, key):
    import ipaddress

    plain = ipaddress.IPv6Address(t).exploded.replace(":", "")
    new = text(plain, key, "ipv6", True)
    return ":".join(new[i : i + 4] for i in range(0, 32, 4))


def day(d, key):
    n = (d - datetime.date(2000, 1, 1)).days
    cycle = n // 146097
    return datetime.date(2000, 1, 1) + datetime.timedelta(cycle * 146097 + number(n - cycle * 146097, 189, 773, key, "date"))


def iso_date(t, key):
    return day(datetime.date.fromisoformat(t), key).isoformat()


def dmy_date(t, key):
    sep = re.search("[./]", t).group()
    a, b, y = (int(x) for x in t.split(sep))
    swapped = b > 12
    d = day(datetime.date(y, a if swapped else b, b if swapped else a), key)
    pad = "02d" if re.match(r"0|\d\d[./]\d\d", t) else "d"
    first, second = (d.month, d.day) if swapped else (d.day, d.month)
    return f"{first:{pad}}{sep}{second:{pad}}{sep}{d.year:04d}"


def secret(t, key):
    head = re.match(r"""(?i:[a-z_]+)\s{0,2}[=:]\s{0,2}["']?""", t)
    head = head.group() if head else ""
    v = t[len(head) :]
    return head + text(v, key, "secret", bool(re.fullmatch("[0-9A-Fa-f]{16,}", v)))


def ssn(t, key):
    a, g, s = (int(x) for x in t.split("-"))
    n = number(((a - 1 if a < 666 else a - 2) * 99 + g - 1) * 9999 + s - 1, 898 * 33, 3 * 9999, key, "ssn")
    a = n // (99 * 9999)
    return f"{a + 1 if a < 665 else a + 2:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


def dni(t, key):
    new = text(t[:8], key, "dni")
    return new + t[8:-1] + "TRWAGMYFPDXBNJZSQVHLCKE"[int(new) % 23]


def iban(t, key):
    plain = t.replace(" ", "")
    body = text(plain[4:], key, "iban")
    rest = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    new = iter(f"{plain[:2]}{98 - rest:02d}{body}")
    return "".join(c if c == " " else next(new) for c in t)


VALUES = [
    (card, "4111 1111 1111 1111"), (card, "5500005555555559"), (card, "3782-822463-10005"), (phone, "+1 (551) 555-0826"), (phone, "551-555-0826"), (phone, "+351 912 345 678"), (phone, "+44 20 7946 0958"), (phone, "+7 495 123 45 67"),
    (email, "a.b+c.24@mail4.example.com"), (ipv4, "152.143.123.131"), (ipv6, "2001:db8:85a3::8a2e:370:7334"), (ipv6, "fe80::1"), (iso_date, "2024-02-29"), (iso_date, "1850-07-01"), (dmy_date, "31.12.1999"), (dmy_date, "7/4/2011"), (dmy_date, "12/25/2010"),
    (secret, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), (secret, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff'), (secret, "password: hunter22x"), (ssn, "123-45-6789"), (ssn, "899-99-9999"), (dni, "12345678Z"), (dni, "12345678-Z"),
    (iban, "GB82 WEST 1234 5698 7654 32"), (iban, "DE89370400440532013000"), (iban, "FR14 2004 1010 0505 0001 3M02 606"),
]
