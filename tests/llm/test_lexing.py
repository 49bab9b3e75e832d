"""The lexer of secret scans: targets, values and constants of source and configuration text."""

import random
import time

import pytest

from strandmill.llm import secrets

V = "Zx81kQ0pLm93"


def values(text):
    return [text[a:b] for a, _, k, b, _ in secrets.find_secrets(text) if k == "literal"]


@pytest.mark.parametrize("text", [
    f'aws_secret_access_key:\n  "{V}"\nnext: 1\n', f"signing_key = '''{V}'''\n", f'signing_key = """{V}"""', f'<add key="signingkey" value="{V}"/>',
    f'<add value="{V}" name="signingkey"/>', f'{{"signing_key": {{"value": "{V}"}}}}', f'x = os.getenv("SIGNING_KEY", "{V}")', f'signing_key = os.getenv("K", "{V}")',
    f'signing_key = os.environ.get("K") or "{V}"', f'client_credential = LATER\nLATER = "{V}"\n', f'signing_key = c\na = "{V}"\nb = a\nc = b\n', f'conn = "Server=x;Uid=me;Pwd={V};"',
    f"# signing_key = {V}\n", f"x = 1 # note\nsigning_key = {V} # the key\n", f'/* signing_key = "{V}" */', f'signing_key: str = "{V}"', f'd["signing_key"] = "{V}"',
    f"define('AUTH_CREDENTIAL', '{V}');", f'connect(host="h", passphrase="{V}")', f"--passphrase {V}", f"Authorization: Bearer {V}", f"credentials:\n  - {V}\n  - other\nz: 1",
    f'url = "postgres://user:{V}@host/db"', f'const signingKey =\n  "{V}";', f"x = signing_key = '{V}'", f"pass_word = f'{V}'", f'signing_key = SecretStr("{V}")', f"signing_key=>'{V}'",
])
def test_values_of_sensitive_targets(text):
    assert values(text) == [V]
    assert V not in secrets.redacted(text, secrets.find_secrets(text))


def test_concatenations_are_folded_and_blocks_read():
    assert values(f'signing_key = "abc" + "{V}"') == ["abc", V]
    assert values('signing_key = "ab1c" + "de2f" + "gh3i"') == ["ab1c", "de2f", "gh3i"]
    assert values("private_key: |\n  abcd1234efgh\n  ijkl5678mnop\nz: abcd1234efgh\n") == ["abcd1234efgh", "ijkl5678mnop"]
    assert values('private_key = """Zx81kQ0p\nline2x91kk"""') == ["Zx81kQ0p\nline2x91kk"]
    assert values("pwd: correct horse battery staple 9\nx: 1\n") == ["correct horse battery staple 9"]


@pytest.mark.parametrize("text", [
    "I don't think the secret: a token of 5 apples was good. It's a password that you \"must\" keep.", 'passphrase = prompt("Please enter 12 words")', "tokens = ['the','cat']",
    'passphrase = config.get("x")', f"x = 1 # KEY = {V}\nsigning_key = KEY\n", f'if signing_key == "{V}": pass', f"signing_key:\nother: {V}\n", f'signing_key = {{}}\nother = "{V}"',
    "a = b\nb = a\nsigning_key = a\n", "the credential, and more: <none> (of them)", None, "",
])
def test_what_is_no_secret(text):
    assert [x for x in secrets.find_secrets(text) if x[2] == "literal"] == []


def test_names_of_any_length():
    name = "x" * 5_000 + "_signing_key"
    assert values(f"{name} = {V}") == [V] and values(f'{{"{name}": "{V}"}}') == [V]


@pytest.mark.parametrize("unit", ["token=", 'signing_key "\\"', "signing_key # ", "signing_key:{([", "signing_key /* ", "signing_key ''' ", "signing_key:\n ", "<a (signing_key=1 >", "pwd: a b 9 ", "\"", "\\\"", "a.b-"])
def test_unbalanced_text_takes_linear_time(unit):
    def took(n):
        began = time.process_time()
        secrets.find_secrets("signing_key " + unit * n)
        return time.process_time() - began

    took(1_000)
    assert took(40_000) < 40 * took(4_000) + 0.5


def test_any_text_is_read():
    rng = random.Random(3)
    parts = [*"\"'`=:;,#/*<>(){}[]|&\\\n -+.$", "signing_key", "value", "name", V, "'''", '"""', "or", "  ", "é", "--password"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        spans = secrets.find_secrets(text)
        assert all(0 <= a < b <= len(text) for a, _, _, b, _ in spans) and spans == sorted(spans)


@pytest.mark.parametrize("n", [10, 300, 5000])
def test_nothing_is_cut_by_length(n):
    """Names, user names, lines before a key and values may have any length."""
    long = "a" * n
    assert values(f"--{long}-secret-key {V}") == [V]
    assert values(f"x {long} credential:\n    {V}\nnext: 1\n") == [V] or values(f"  {long} credential:\n    {V}\n") == [V]
    assert values(f'url = "postgres://{long}:{V}@host/db"') == [V]
    phrase = " ".join(["horse"] * n) + " 9"
    assert values(f"pwd: {phrase}\nx: 1\n") == [phrase]
    value = f"{V * n}=key"
    assert values(f"q=1:signing_key={value}{V}") == [f"{value}{V}"]


def test_endings_score_as_their_texts():
    rng = random.Random(4)
    for text in ["".join(rng.choice("abcXYZ019+/=<>${}") for _ in range(900)), "your" + "a1b2" * 100, "<" + "ab9" * 200 + ">", "${" + "k3j" * 200 + "}", "x" * 700, "example" + "q8w" * 150]:
        endings = secrets.Endings(text, 0, len(text))
        for at in range(len(text)):
            assert abs(endings.strength(at) - secrets.literal_strength(text[at:])) < 1e-9


def test_generated_configuration_files():
    """Against a reading by lines: every sensitive name of .env, ini, JSON and YAML files, and nothing else."""
    import json

    rng = random.Random(6)
    for n in range(40):
        names = rng.sample(["db_passphrase", "signing_key", "host", "service.credential", "colour", "client_access_key", "title", "private-key", "port_name"], 6)
        pairs = {k: "".join(rng.choice("abcdefghkmnpqrstuvwxyz23456789") for _ in range(14)) + "7q" for k in names}
        wanted = sorted(v for k, v in pairs.items() if any(x in k.replace("_", "").replace("-", "") for x in ("passphrase", "signingkey", "credential", "accesskey", "privatekey")))
        files = ["".join(f"{k.upper()}={v}\n" for k, v in pairs.items()), "[main]\n" + "".join(f"{k} = {v}\n; note\n" for k, v in pairs.items()), json.dumps({"a": pairs}, indent=n % 3 or None),
                 "top:\n" + "".join(f"  {k}: {v}\n" for k, v in pairs.items())]
        for text in files:
            assert sorted(values(text)) == wanted, text
