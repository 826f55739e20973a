import random
import unicodedata

import pytest

from docveil.operators import egress, gate

KNOWN = [
    ("34 ABC 123", "PLAKA"), ("TR330006100519786457841326", "IBAN"), ("12345678950", "TCKN"), ("2024/5678 E.", "DOSYA_NO"), ("Lale Sok. No:10", "ADRES"),
    ("Ayşe Yılmaz-Demir", "KISI"), ("0532 123 45 67", "TELEFON"), ("ayse.kara@ornek.com", "EPOSTA"), ("2025/7", "SAYI"), ("Kara", "KISI"), ("Poyraz & Oğlu A.Ş.", "SIRKET"),
]


def cleaned(text, values=KNOWN):
    scanner = egress.Scanner((v, t, f"<{t}>") for v, t in values)
    return egress.cleaned(text, scanner.scan(text))


@pytest.mark.parametrize("text, want", [
    ("34ABC123 34-abc-123 34 ABC 1234 134 ABC 123", "<PLAKA> <PLAKA> 34 ABC 1234 134 ABC 123"),
    ("33 0006 1005 1978 6457 8413 26; IBANTR330006100519786457841326", "<IBAN>; IBAN<IBAN>"), ("TR33–0006–1005—1978.6457_8413/26", "<IBAN>"),
    ("TC12345678950 123 456 789 50 123456789501", "TC<TCKN> <TCKN> 123456789501"), ("Esas 2024/5678; 2024 - 5678 sayılı; 2024/56789", "Esas <DOSYA_NO>; <DOSYA_NO> sayılı; 2024/56789"),
    ("Lale Sok. No10, LALE SOK. No: 10; Lale Sok. No:101", "<ADRES>, <ADRES>; Lale Sok. No:101"),
    ("Ayşe YılmazDemir, ayse yilmaz demir, Ayşe Yılmaz - Demir", "<KISI>, <KISI>, <KISI>"),
    ("0090 (532) 123 4567; 532 123 45 67; 0532–123–45–67; 05321234567890", "<TELEFON>; <TELEFON>; <TELEFON>; 05321234567890"),
    ("AYSE.KARA@ORNEK.COM ayse kara@ornek.com", "<EPOSTA> ayse kara@ornek.com"), ("2025/7, 2025 / 7; 2025/7/15 12025/7 3/2025/7", "<SAYI>, <SAYI>; 2025/7/15 12025/7 3/2025/7"),
    ("Kara kara Karaköy Kara'nın Ḱara", "<KISI> kara Karaköy <KISI>'nın <KISI>"), ("{{KARA-01}} Ka-\n  ra", "{{KARA-01}} <KISI>"),
    ("Poyraz & Oğlu A.Ş. Poyraz Oğlu", "<SIRKET>. Poyraz Oğlu"), ("", ""), ("x", "x"),
])
def test_spellings(text, want):
    assert cleaned(text) == want


def test_short_values_are_not_looked_for():
    for value, kind in (("Ak", "KISI"), ("12345", "TCKN"), ("A1", "PLAKA"), ("", "KISI"), ("--", "KISI"), ("​", "KISI")):
        assert not [f for f in egress.forms_of(kind, value) if len(f.compact) < 4], value
    assert egress.forms_of("KISI", "Ak") == () and egress.Scanner([("Ak", "KISI", "x")]).scan("Ak Ak") == []


def test_places_are_those_of_each_character():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("abIİıéＡﬁß1- \ń­​\U0001f600東ǆΣ") for _ in range(rng.randrange(40)))
        normal, want = egress.Normalised(text), []
        for i, c in enumerate(text):
            for d in unicodedata.normalize("NFKD", c.translate(egress.FOLD)) if unicodedata.category(c) not in ("Cf", "Mn", "Me", "Mc") else "":
                want += [(e, i) for e in d.lower() if unicodedata.category(e) not in ("Cf", "Mn", "Me", "Mc")]
        assert normal.text == "".join(e for e, _ in want)
        assert [normal.place(k) for k in range(len(want))] == [i for _, i in want]
        assert len(normal.starts) <= 2 * len(egress.OTHERS.findall(text)) * 3 + 1


def test_both_ways_meet_the_same(spark):
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = [(m, t, f"{{{{{t}-{m}{k}}}}}", v()) for m in "ab" for k in range(12) for t, v in (("TELEFON", lambda: "0532" + digits(7)), ("TCKN", lambda: "1" + digits(10)), ("KISI", lambda: f"Ece {rng.choice(['Ak', 'Kaya', 'Öz-Tan'])} Soy{digits(2)}"), ("PLAKA", lambda: f"34 AB {digits(3)}"))]
    values += [(None, "KISI", "x", "Ali Veli"), ("a", "KISI", "y", None)]
    texts = []
    for i in range(300):
        shown = [rng.choice(values)[3] or "" for _ in range(3)]
        texts.append((i, rng.choice(["a", "b", "c", None]), " ; ".join(rng.choice([s, s.upper(), s.replace(" ", ""), s.replace(" ", "-")]) for s in shown)))
    texts += [(900, "a", None), (901, "a", "")]
    values, texts = (spark.createDataFrame(rows, f"{keys}string") for rows, keys in ((values, "matter_id string, label_type string, label string, value "), (texts, "out_id long, matter_id string, text ")))
    one, other = (sorted(map(tuple, gate.gate(texts, values, **more).collect()), key=str) for more in ({}, {"sent": 0}))
    assert one == other and len(one) > 150
    assert gate.gate(texts, values.limit(0)).count() == 0 and gate.gate(texts.limit(0), values, sent=0).count() == 0
