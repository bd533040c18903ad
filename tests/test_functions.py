from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.functions import chat, keywords, packages, severity, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def lit(v):
    return F.lit(v).cast("string") if v is None else F.lit(v)


@pytest.mark.parametrize(("score", "level", "want"), [("9.8", "note", "CRITICAL"), ("7.0", "note", "HIGH"), ("4", None, "MEDIUM"), ("0.1", "error", "LOW"), ("no number", "error", "HIGH"), (None, "warning", "MEDIUM"), (None, "note", "LOW"), (None, "odd", "UNKNOWN"), (None, None, "UNKNOWN")])
def test_of_rule(spark, score, level, want):
    assert one(spark, severity.of_rule(lit(score), lit(level))) == want


def test_levels_and_codes(spark):
    assert [one(spark, severity.of_level(lit(v))) for v in ("Error", "none", "odd", None)] == ["HIGH", "INFO", "MEDIUM", "MEDIUM"]
    assert [one(spark, severity.of_risk(lit(v))) for v in ("3", "0", None, "9")] == ["HIGH", "INFO", "INFO", "UNKNOWN"]
    assert [one(spark, severity.of_advisory(lit(v))) for v in ("Severity: Low or HIGH", "none", None)] == ["high", "medium", "medium"]


def test_importance(spark):
    assert one(spark, severity.importance(F.lit("HIGH"), F.lit("x vulnerability_classification"), F.lit(True))) == pytest.approx(1.3 * 1.2 * 1.1)
    assert one(spark, severity.importance(lit(None), lit(None), F.lit(False))) == 1.0


def test_strip_html(spark):
    assert one(spark, text.strip_html(F.lit("<p>a &lt;b&gt; &amp;  c</p>\n<br/>d&quot;&#39;"))) == "a <b> & c d\"'"
    assert one(spark, text.strip_html(lit(None))) is None


def test_labelled_line(spark):
    body = F.lit("Package: org.x:y\nInstalled Version: 1.0\nFixed Version: \nLink: [id](https://e/x)")
    assert one(spark, text.labelled_line(body, "Package")) == "org.x:y"
    assert one(spark, text.labelled_line(body, "Fixed Version")) == ""
    assert one(spark, text.labelled_line(body, "Severity")) is None


def test_sentences_and_parts(spark):
    assert one(spark, text.first_sentence(F.lit("One. Two."))) == "One."
    long = one(spark, text.first_sentence(F.lit("x" * 300)))
    assert len(long) == 200
    assert long.endswith("...")
    parts = one(spark, text.labelled_parts(F.lit("Impact: bad. Remediation: fix it. Prevention: care")))
    assert parts.asDict() == {"impact": "bad", "remediation": "fix it", "prevention": "care"}
    assert one(spark, text.between(F.lit("a <s>x y</s> b"), "<s>", "</s>")) == "x y"
    assert one(spark, text.between(F.lit("nothing"), "<s>", "</s>")) is None
    assert one(spark, text.sections(F.lit("head\nImpact:\na\nb\nFix:\nc"), ["Impact", "Fix"])) == {"Impact": "a\nb", "Fix": "c"}


def test_versions(spark):
    assert one(spark, text.version(F.lit("v2.10"))) == [2, 10, 0]
    assert one(spark, text.version(F.lit("latest"))) is None
    versions = F.array(*map(F.lit, ["1.9", "1.10", "1.9"]))
    assert one(spark, text.newest_versions(versions)) == ["1.9", "1.10"]
    assert one(spark, text.newest_versions(versions, numeric=True)) == ["1.10", "1.9"]
    assert one(spark, text.find_version(F.lit('implementation("com.yubico:server:2.5.0")'))) == "2.5.0"


def test_durations_and_encodings(spark):
    import datetime

    assert one(spark, text.duration(F.lit("180d"))) == datetime.timedelta(days=180)
    assert one(spark, text.duration(F.lit("30 s"))) == datetime.timedelta(seconds=30)
    assert one(spark, text.duration(F.lit("soon"))) is None
    assert one(spark, text.url_safe(F.lit(b"\xfb\xff\xfe\x01"))) == "-__-AQ"
    token = "e30.eyJlbnRyaWVzIjpbeyJhIjoxfV19.x"
    assert one(spark, text.jwt_payload(F.lit(token), "entries array<struct<a: int>>"))["entries"][0]["a"] == 1
    assert one(spark, text.safe_decode(F.lit("né".encode()))) == "né"
    assert one(spark, text.safe_decode(F.lit(b"n\xe9"))) == "né"
    assert one(spark, text.safe_decode(F.lit(b"long"), 3)) is None


def test_packages(spark):
    e = lambda n, u: one(spark, packages.ecosystem(F.lit(n), lit(u)))
    assert [e("a:b", ""), e("@a/b", None), e("x", "requirements.txt"), e("x", "Alpine.tar"), e("x", "i.tar"), e("x", None)] == ["maven", "npm", "pip", "os_apk", "os_apt", "unknown"]
    fix = one(spark, packages.upgrade_fix(F.lit("a:b"), F.lit("1"), F.lit("2, 3"), F.lit("maven")))
    assert fix["to_version"] == "2"
    assert fix["fixed_code"] == 'implementation("a:b:2")'
    assert [a["fixed_code"] for a in fix["alternatives"]] == ['implementation("a:b:3")']
    assert one(spark, packages.parse_upgrade(F.lit(fix["description"]))).asDict() == {"package": "a:b", "from_version": "1", "to_version": "2"}
    assert one(spark, packages.upgrade_fix(F.lit("a"), F.lit("1"), F.lit(""), F.lit("pip"))) is None
    c = lambda p: one(spark, packages.config_type(F.lit(p)))
    assert [c(".github/workflows/a.yml"), c("x/Dockerfile"), c("k8s/a.yaml"), c("a.tf"), c("a.yml"), c("a")] == ["github_actions", "dockerfile", "kubernetes", "terraform", "yaml_config", "config"]


DIFF = "--- a/x.py\n+++ b/x.py\n-old\n+new\n+more\n same\n+++ b/y.js\n+++ b/z.py"


def test_diffs(spark):
    assert one(spark, packages.diff_side(F.lit(DIFF), "-")) == "old"
    assert one(spark, packages.diff_side(F.lit(DIFF), "+")) == "new\nmore"
    assert one(spark, packages.changed_paths(F.lit(DIFF))) == ["x.py", "y.js", "z.py"]
    assert one(spark, packages.diff_language(F.lit(DIFF))) == "Python"
    assert one(spark, packages.diff_language(F.lit("nothing"))) == "Unknown"
    stat = one(spark, packages.numstat(F.lit("1\t2\ta.py\n-\t-\tb.png\n3\t4\ta.py")))
    assert {k: tuple(v) for k, v in stat.items()} == {"a.py": (3, 4), "b.png": (0, 0)}
    assert one(spark, packages.context(F.lit("a\nb\nc\nd"), F.lit(2), 1)) == "   1 | a\n   2 | b\n   3 | c"


def test_is_source(spark):
    s = lambda p: one(spark, packages.is_source(F.lit(p)))
    assert [s("src/a.kt"), s("./a.kt"), s("a.py")] == [True] * 3
    assert not any([s("https://e/x"), s("library/nginx"), s("nginx:alpine"), s("a/b:1"), s("x.jar"), s("a/build/x.kt"), s("org.apache.commons"), s("a:b:c"), s("")])


def test_keywords(spark):
    assert one(spark, keywords.categories(F.lit("Validate user data; encrypt"))) == ["validation", "cryptography", "input_handling"]
    assert one(spark, keywords.categories(lit(None))) == []
    assert one(spark, keywords.first_class(F.lit("a shell script"))) == "xss"
    assert one(spark, keywords.first_class(F.lit("nothing"))) == "generic_security_issue"
    c = one(spark, keywords.categorised(F.lit("semgrep"), F.lit("passkey challenge"), lit(None), lit(None)))
    assert c["category"] == "webauthn_security"
    assert c["confidence"] == pytest.approx(0.9)
    assert one(spark, keywords.categorised(F.lit("trivy"), lit(None), F.lit("d" * 101), F.lit("HIGH")))["confidence"] == pytest.approx(0.8)
    assert one(spark, keywords.categorised(F.lit("odd"), lit(None), lit(None), lit(None))) is None
    r = lambda t: one(spark, keywords.relevant(lit(t)))
    assert [r("A WebAuthn flaw over TLS"), r("credential in the browser"), r("credential"), r("oauth credential in the browser"), r(None)] == [True, True, False, False, False]
    assert one(spark, keywords.affected_components(F.lit("x"))) == ["general webauthn"]


def test_chat(spark):
    m = F.array(chat.message("system", F.lit("s")), chat.message("user", F.lit("u")), chat.message("assistant", F.lit("a")))
    assert one(spark, chat.chatml(m)) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>"
    pair = one(spark, chat.prompt_and_answer(m))
    assert ([p["role"] for p in pair["prompt"]], pair["answer"]) == (["system", "user"], "a")
    assert one(spark, chat.prompt_and_answer(F.array(chat.message("user", F.lit("u"))))) is None
    assert one(spark, chat.code_example(F.lit("py"), lit(None), F.lit(" "), F.lit("x"))) is None
    story = chat.narrative(F.lit("ID"), F.lit("HIGH"), F.lit("zap"), F.lit("p"), F.lit("text"))
    rows = one(spark, chat.instructions(story))
    assert [r["response"] for r in rows][:2] == ["text", "Follow the fix of ID."]
    assert one(spark, chat.vary_intro(F.lit("Something else\nx"), F.lit(1))) == "Something else\nx"
