"""Personal data and secrets against the contract's patterns, used as they are written there."""

import base64
import hashlib
import json
import random
import re
import time

from pairwright.llm import pii, secrets


def plain_pii(text):
    """The base spans by the patterns as given."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def noise(seed, parts, n=40):
    r = random.Random(seed)
    return "".join(r.choice(parts) for _ in range(n))


def test_pii_equals_the_plain_patterns_on_noise():
    parts = ["a", "@", ".", "-", "+", " ", "1", "12", "255", "300", "4111 1111 1111 1111", "(", ")", "é", "b.c", "@x.y", "+1 (555) 123-4567", "0" * 20, "%", "1.2.3.4"]
    for seed in range(3000):
        text = noise(seed, parts)
        assert [(s.kind, s.start, s.end) for s in pii.spans(text) if s.kind in pii.BASE] == plain_pii(text), text


def test_secrets_equal_the_plain_patterns_on_noise():
    parts = ["token", "PASSWD", "password", "api_key", "APIKEY", " ", "=", ":", '"', "'", "abcdef0123456789", "AKIA", "ABC123DEF456XY", "ff", "x", "_", "ſ", "toKen", "é"]
    for seed in range(3000):
        text = noise(seed, parts)
        assert [s for s in secrets.spans(text) if s[0] in secrets.BASE] == plain_secrets(text), text


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert [s.kind for s in pii.spans("account GB82 WEST 1234 5698 7654 32 and")] == ["iban"]
    for after in ("AND", "BIC COBADEFF", "12", ".", ""):
        found = pii.spans(f"to DE89 3704 0044 0532 0130 00 {after}")
        assert [(s.kind, s.start, s.end) for s in found if s.kind == "iban"] == [("iban", 3, 30)], after
    assert [s.kind for s in pii.spans("GB82 WEST 1234 5698 7654 32 AND")] == ["iban"] and pii.spans("GB82WEST12345698765432X") == []
    assert [s.kind for s in pii.spans("GB82WEST12345698765432")] == ["iban"]
    assert [s.kind for s in pii.spans("my ssn is 123-45-6789")] == ["ssn"]
    assert pii.spans("lot 123-45-6789 of bolts") == []


def test_masking_and_empties():
    text = "Write to a.b@c.org or 10.0.0.1!"
    assert pii.masked(text, pii.spans(text)) == "Write to <EMAIL> or <IP>!"
    assert pii.spans(None) == [] and pii.spans("") == [] and secrets.spans(None) == []


def test_structures_confirm():
    enc = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    jwt = f"{enc(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{enc(b'{}')}.{enc(b'sig')}"
    assert [s[0] for s in secrets.spans(f"see {jwt} there")] == ["jwt"]
    assert not secrets.spans(f"see {enc(b'{"x": 1, "y": 22}')}.{enc(b'{}')}.abc there")
    der = b"\x30\x26\x02\x01\x00\x04\x21" + bytes(range(33))
    assert secrets.is_der(der) and not secrets.is_der(der + b"x")
    assert [s[0] for s in secrets.spans(f"k {base64.b64encode(der).decode()} k")] == ["der"]
    # Nested lengths have to add up too.
    nested = b"\x30\x1c\x02\x01\x00\x30\x17\x04\x15" + bytes(21)
    assert secrets.is_der(nested) and not secrets.is_der(nested[:6] + b"\x17\x04\x14" + bytes(21))
    ssh = b"\0\0\0\x0bssh-ed25519\0\0\0\x20" + bytes(32)
    field = lambda x: len(x).to_bytes(4, "big") + x
    private = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(ssh) + field(bytes(64))
    assert secrets.is_ssh(private) and not secrets.is_ssh(private[:-1]) and not secrets.is_ssh(b"openssh-key-v1\0junk")
    assert [s[0] for s in secrets.spans(f"KEYDATA={base64.b64encode(ssh).decode()}")] == ["ssh"]
    assert [s[0] for s in secrets.spans(f"It was {jwt}. Next")] == ["jwt"] and not [s for s in secrets.spans(f"It was {jwt}.more") if s[0] == "jwt"]
    assert [s[0] for s in secrets.spans(f"ssh-ed25519 {base64.b64encode(ssh).decode()} me@host")] == ["ssh"]
    pem = f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(der).decode()}\n-----END PRIVATE KEY-----"
    assert "pem" in [s[0] for s in secrets.spans(pem)]


ENC = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def test_tokens_by_their_headers():
    body, sig = ENC(b'{"sub": "1"}'), ENC(b"signature")
    for header in ('{"alg":"HS256"}', '{ "alg": "none" }', '\n{"alg":"RS256"}', '{\r\n "typ":"JWT",\r\n "alg":"ES256"}'):
        token = f"{ENC(header.encode())}.{body}.{sig}"
        for before, after in (("", ""), ("Bearer ", ". Next"), ('"', '"'), ("x ", "...")):
            assert [x for x in secrets.spans(f"{before}{token}{after}") if x[0] == "jwt"] == [("jwt", len(before), len(before) + len(token))], (header, after)
    sealed = f"{ENC(b'{"alg":"dir","enc":"A256GCM"}')}..{ENC(bytes(12))}.{ENC(bytes(40))}.{ENC(bytes(16))}"
    assert [x[0] for x in secrets.spans(f"it is {sealed}.")] == ["jwt"]
    for wrong in (f"{ENC(b'[1]')}.{body}.{sig}", f"{ENC(b'{"alg": 1}')}.{body}.{sig}", f"{ENC(b'{"alg":"x"}')}.{ENC(b'[]')}.{sig}", f"{ENC(b'{"alg":"dir"}')}.a.b.c.d", "www.example.co.uk", "1.2.3.4"):
        assert not [x for x in secrets.spans(wrong) if x[0] == "jwt"], wrong


def der_of(r, size):
    """A sequence of an integer and octets, of about ``size`` bytes, its length written in as few bytes as it takes."""
    inner = b"\x02\x01\x00\x04\x82" + size.to_bytes(2, "big") + r.randbytes(size)
    return b"\x30\x82" + len(inner).to_bytes(2, "big") + inner


def test_wrapped_base64_and_hexadecimal_of_either_case():
    r = random.Random(8)
    for size in (60, 61, 62, 143, 400, 1200):
        data = der_of(r, size)
        plain = base64.b64encode(data).decode()
        for width in (48, 64, 76):
            for indent in ("", "  ", "\t"):
                for line_end in ("\n", "\r\n"):
                    lines = [plain[i : i + width] for i in range(0, len(plain), width)]
                    wrapped = f"{line_end}{indent}".join(lines)
                    for after in ("", " and", "\n\nNext", "\n-- \nme"):
                        assert secrets.spans(f"key:\n{wrapped}{after}") == [("der", 5, 5 + len(wrapped))], (size, width, after)
        for spelled in (data.hex().upper(), data.hex()):
            assert ("der", 2, 2 + len(spelled)) in secrets.spans(f"x {spelled} y")
            assert not [x for x in secrets.spans(f"x {spelled[:-2]} y") if x[0] == "der"]
        broken = "\n".join(lines[:1] + lines[2:])
        assert not [x for x in secrets.spans(broken) if x[0] == "der"]
    full = der_of(r, 277)  # fills its lines: what follows is no part of it
    text = base64.b64encode(full).decode()
    assert len(full) % 48 == 0 and "=" not in text
    wrapped = "\n".join(text[i : i + 64] for i in range(0, len(text), 64))
    assert secrets.spans(f"{wrapped}\nRegards") == [("der", 0, len(wrapped))]


def test_private_keys_with_headers_and_escaped_lines():
    r = random.Random(9)
    sealed = base64.b64encode(r.randbytes(640)).decode()
    lines = "\n".join(sealed[i : i + 64] for i in range(0, len(sealed), 64))
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{head}{lines}\n-----END RSA PRIVATE KEY-----"
    assert ("pem", 2, 2 + len(pem)) in secrets.spans(f"a {pem} b")
    assert not [x for x in secrets.spans(pem.replace(lines, lines[:-3])) if x[0] == "pem"]
    assert not [x for x in secrets.spans(pem.replace(head, "")) if x[0] == "pem"]
    data = base64.b64encode(der_of(r, 300)).decode()
    escaped = json.dumps({"private_key": "-----BEGIN PRIVATE KEY-----\n" + "\n".join(data[i : i + 64] for i in range(0, len(data), 64)) + "\n-----END PRIVATE KEY-----\n"})
    assert [x[0] for x in secrets.spans(escaped) if x[0] == "pem"] == ["pem"]


def fills(data):
    """Whether a DER element fills the data, by its definition; constructed ones all the way down."""
    def element(at, end):
        if at + 2 > end:
            return None
        first = data[at + 1]
        if first < 0x80:
            begin, n = at + 2, first
        else:
            k = first - 0x80
            if not 1 <= k <= 4 or at + 2 + k > end:
                return None
            begin, n = at + 2 + k, int.from_bytes(data[at + 2 : at + 2 + k], "big")
        if begin + n > end:
            return None
        if data[at] & 0x20:
            inner = begin
            while inner < begin + n:
                if (inner := element(inner, begin + n)) is None:
                    return None
        return begin + n

    return len(data) >= 24 and data[0] == 0x30 and element(0, len(data)) == len(data)


def test_added_secrets_by_brute_force():
    """Every maximal run of small texts, decoded by itself: what has a form is found, and nothing else."""
    r = random.Random(10)
    wide = re.compile("[A-Za-z0-9+/_-]{40,}")
    for trial in range(400):
        parts = []
        for _ in range(r.randrange(1, 5)):
            data = der_of(r, r.randrange(40, 90))
            if r.random() < 0.4:
                data = bytearray(data)
                data[r.choice([0, 1, 3, 4, 5, 6, 8, 10])] ^= r.choice([1, 4, 0x20])
            text = r.choice([lambda d: base64.b64encode(d).decode().rstrip("="), lambda d: d.hex(), lambda d: d.hex().upper(), lambda d: ENC(bytes(d))])(data)
            parts += [text, r.choice([" ", ", ", " x\n\n", ";"])]
        text = "".join(parts)
        want = set()
        for m in wide.finditer(text):
            hexed = re.fullmatch("([0-9a-f]{2})+|([0-9A-F]{2})+", m[0])
            ways = [bytes.fromhex(m[0])] if hexed else []
            if len(m[0]) % 4 != 1:
                ways.append(base64.b64decode(m[0].replace("-", "+").replace("_", "/") + "=" * (-len(m[0]) % 4)))
            if any(fills(d) and d[1] >= 0x80 and d[4] in (2, 0x30) for d in ways):
                want.add(("der", *m.span()))
        assert {x for x in secrets.spans(text) if x[0] not in secrets.BASE} == want, (trial, text)


def test_added_personal_data_by_brute_force():
    """All substrings of small texts: an account number of its country's length, or a number of three, two and four digits that may be."""
    r = random.Random(11)

    def iban(bare):
        return len(bare) == int(pii.IBAN_LENGTHS.get(bare[:2], 0)) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1

    def checked(country, body):
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{98 - rest:02}{body}"

    for _ in range(600):
        parts = []
        for _ in range(r.randrange(1, 4)):
            country = r.choice(["DE", "GB", "NO", "XX", "FR"])
            size = int(pii.IBAN_LENGTHS.get(country, 20)) - 4 + r.choice([0, 0, 0, 1, -1])
            number = checked(country, "".join(r.choice("0123456789AB") for _ in range(size)))
            if r.random() < 0.3:
                number = number[:5] + r.choice("0123456789") + number[6:]
            if r.random() < 0.5:
                number = " ".join(number[i : i + 4] for i in range(0, len(number), 4))
            digits = "".join(r.choice("0123456789") for _ in range(9))
            ssn = f"{r.choice([digits[:3], '000', '666', '912'])}-{digits[3:5]}-{digits[5:]}"
            parts += [r.choice([number, f"bank {number}", ssn, f"ssn {ssn}"]), r.choice([" ", ", ", ". ", "; no ", "-", "x "])]
        text = "".join(parts)
        want, end = [], 0
        for i in range(len(text)):
            if i < end or (i and text[i - 1].isalnum()):
                continue
            for j in range(i + 15, min(len(text), i + 2 * 34) + 1):
                part = text[i:j]
                if re.fullmatch(r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9])+", part) and iban(part.replace(" ", "")) and not text[j : j + 1].isalnum():
                    want.append(("iban", i, j))
                    end = j
                    break
        for i in range(len(text) - 10):
            if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", part := text[i : i + 11]) and not re.match("[0-9-]", text[i - 1 : i] if i else "") and not re.match("[0-9-]", text[i + 11 : i + 12]):
                near = f"{text[max(0, i - 40) : i]} {text[i + 11 : i + 51]}".lower()
                if part[:3] not in ("000", "666") and part[0] != "9" and part[4:6] != "00" and part[7:] != "0000" and re.search(r"(?<![a-z-])(ssn|social|security)(?![a-z-])", near):
                    want.append(("ssn", i, i + 11))
        assert [(s.kind, s.start, s.end) for s in pii.spans(text) if s.kind not in pii.BASE] == want, text


def test_long_texts_take_linear_time():
    began = time.time()
    for unit in ("1", "1.", "a", "a@", "+1(", "token ", "f", "A", "1 ", "a.b", "eyJh.", "MIIB" * 16 + "\n", "-----BEGIN PRIVATE KEY-----\n"):
        pii.spans(unit * 300_000)
        secrets.spans(unit * 300_000)
    assert time.time() - began < 30


def test_over_a_table(spark):
    rows = [(1, "x a@b.cd y", "z"), (2, None, None), (3, "", "q"), (1, "x a@b.cd y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {(r.doc_id, r.n_email, r.spans, r.base_sha256) for r in pii.pii_digest(df).collect()}
    assert {(r.doc_id, r.scores, r.confident) for r in pii.pii_digest(df).collect()} == {(1, "0.900", "email:2:8"), (2, "", ""), (3, "", "")}
    none = hashlib.sha256(b"").hexdigest()
    assert out == {(1, 1, "email:2:8", hashlib.sha256(b"email:2:8").hexdigest()), (2, 0, "", none), (3, 0, "", none)}
    assert secrets.secret_digest(df).count() == 4 and secrets.secret_digest(df.limit(0)).count() == 0
    assert pii.mask_pii(df).where("doc_id = 1").first().text == "x <EMAIL> y"
    assert pii.find_pii(df).where("doc_id = 1").first().pii[0].text == "a@b.cd"
    assert secrets.find_secrets(df).where("doc_id = 3").first().secrets == []
