import random
import re
import time

from tabfid.llm import secrets

from . import cases


def naive_base(text):
    """Base spans by the stated patterns, every match and then the lengths."""
    out = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def texts(rng):
    parts = ["password", "PassWD", "token", "api_key", "apikey", "secret", "ſecret", "=", ":", " ", "\"", "'", "abcdefgh12", "AKIA",
             "ABCDEF0123456789", "0123456789abcdef", "deadbeef" * 4, "\n", "é", "😀", "==", ":=", "=>", "://", "\\", "x.y", "{", "}"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)]


def test_base_spans():
    import random
    for t in texts(random.Random(1)):
        assert sorted(secrets.base_spans(t)) == naive_base(t), t
        spans = secrets.find_spans(t)
        assert [s for s in sorted(spans) if s[0] in secrets.KINDS[:3]] == naive_base(t)
        assert spans == sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))


def found(text):
    return [(k, text[a:b]) for k, a, b in secrets.find_spans(text) if k in ("literal", "constant")]


def test_lexing_adds_names_that_the_base_lacks():
    assert found('db_pwd = "Tr0ub4dor&3!x"') == [("literal", "Tr0ub4dor&3!x")]
    assert found("private_key: 'q9Z#fk2L!mm8'") == [("literal", "q9Z#fk2L!mm8")]
    assert found('{"clientSecret" => "a1-B2$c3-D4!e5"}') == [("literal", "a1-B2$c3-D4!e5")]
    assert found('password = "p@ss w0rd!2024"') == [("literal", "p@ss w0rd!2024")]
    assert found('password = "Abcdefgh12345678"') == []  # a base span already


def test_constants_are_propagated():
    t = 'K = "zX9#kq77!pL0"\nalias = K\nprint(1)\nconn(password=alias)'
    assert found(t) == [("constant", "zX9#kq77!pL0")]
    loop = "a = b\nb = a\ntoken = a"
    assert found(loop) == []


def test_typed_assignments():
    one = "zX9#kq77!pL0"
    for t in (f'db_pwd: str = "{one}"\nname: str = "hello"', f'db_pwd: str = "{one}"\nhost_id: str = "Qw3#rt5Yu7!i"',
              f"const dbPwd: string | null = '{one}';\nlet b: string = 'x'", f'val dbPwd: String? = "{one}"',
              f"const DB_PWD: &'static str = \"{one}\";\nconst B: &str = \"b\";", f'db_pwd: dict[str, List[str]] = "{one}"',
              f'def f(a: list[int], db_pwd: std::string = "{one}", b: str = "Qw3#rt5Yu7!i")', f'Example: db_pwd = "{one}"'):
        assert found(t) == [("literal", one)], t
    assert found(f'Example: K = "{one}"\nauth_token = K') == [("constant", one)]
    assert found('host_id: str = "Qw3#rt5Yu7!i"\ndef f(db_pwd: str): pass') == []


def test_reassigned_constants():
    one, two = "zX9#kq77!pL0", "Qw3#rt5Yu7!i"
    assert found(f'K = "{one}"\ndb_pwd = K\nK = "x"') == [("constant", one)]
    assert found(f'K = "{one}"\ndb_pwd = K\nK = "{two}"') == [("constant", one)]
    assert found(f'K = "{one}"\nK = "{two}"\ndb_pwd = K') == [("constant", two)]
    assert found(f'K = "{one}"\nif x:\n    K = "{two}"\ndb_pwd = K') == [("constant", one), ("constant", two)]
    assert found(f'K = "{one}"\nK = K.strip()\nA = K\nK = "x"\ndb_pwd = A') == [("constant", one)]
    assert found(f'def f():\n    db_pwd = K\nK = "{one}"') == [("constant", one)]
    many = f'K = "{one}"\n' + "db_pwd = K\n  K = K\n" * 20_000
    assert found(many) == [("constant", one)]


def test_plain_text_and_placeholders_are_left_alone():
    for t in ("The token: a word in prose. Password: please ask.", 'password = "changeme"', 'api_key = "<your key>"', "auth = None",
              "if pwd == 'Abc12345!x': pass", "see http://example.com/a:b", 'name = "q9Z#fk2L!mm8"', 'pwd = "${VAULT_PATH_1}"', ""):
        assert found(t) == [], t


def test_redaction():
    assert secrets.redact('x password = "Abcdefgh12345678" y') == 'x [SECRET]" y'
    assert secrets.redact(None) is None and secrets.redact("") == "" and secrets.redact("clean") == "clean"
    h = "deadbeef" * 4
    assert secrets.redact(f"token={h} {h}") == "[SECRET] [SECRET]"


def test_table(spark):
    docs = cases.table(spark)
    got = secrets.scan(docs).select("text", "spans").collect()
    assert len(got) == len(cases.documents())
    for r in got:
        assert [tuple(s) for s in r["spans"]] == secrets.find_spans(r["text"])
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns
    assert sorted(str(r["text"]) for r in clean.collect()) == sorted(str(secrets.redact(r[1])) for r in cases.documents())
    assert secrets.scan(cases.table(spark, [])).collect() == []


def test_long_text_takes_linear_time():
    t = "=".join(["a" * 2000] * 200) + ' password = "' + "b1" * 100_000
    assert "assign" in {s[0] for s in secrets.find_spans(t)}

    def seconds(text):
        best = []
        for _ in range(3):
            at = time.perf_counter()
            secrets.find_spans(text)
            best.append(time.perf_counter() - at)
        return min(best)

    for unit in ("token=1&", "a=1&", "token:x=", "token=abcdefgh1 ", "api_key=K ", "token=..", "K=token;token=K\n"):
        one, two = (seconds(unit * (k // len(unit))) for k in (100_000, 200_000))
        assert two < 3.2 * one + 0.02, (unit, one, two)


def test_values_of_one_run_are_scored_alike():
    rng = random.Random(4)
    chars = ["a", "B", "7", "=", "&", "-", "é", "ß", "İ", "\u212a", "none", "xxxx", "$", ".", "token=", "Your"]
    for _ in range(300):
        t = "".join(rng.choice(chars) for _ in range(rng.randrange(1, 60)))
        starts = [a for a in range(len(t)) if rng.random() < 0.5] or [0]
        assert secrets.suffix_scores(t, starts, len(t)) == {a: secrets.literal_score(t[a:]) for a in starts}, t
