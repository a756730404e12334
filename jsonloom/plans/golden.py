"""Golden inputs with their results, each derived from the rules of the operators."""

from __future__ import annotations

#: Fixed values: (document, depth limit, error, offset by stage, offset by earliest); "ok" with -1.
ERRORS = (
    (b"", 1024, "EmptyInput", 0, 0),
    (b" \t\n\r", 1024, "EmptyInput", 0, 0),
    (b"ab\x80", 1024, "Utf8", 2, 2),
    (b"[1 true]", 1024, "MissingComma", 3, 3),
    (b"{}{}", 1024, "MissingComma", 2, 2),
    (b"{} {}", 1024, "MissingComma", 3, 3),
    (b"{},1", 1024, "TrailingContent", 2, 2),
    (b"1,2", 1024, "TrailingContent", 1, 1),
    (b'[""],1', 1024, "TrailingContent", 4, 4),
    (b"[1", 1024, "UnbalancedBrackets", 0, 0),
    (b'{"a":1', 1024, "UnbalancedBrackets", 0, 0),
    (b"[[1]", 1024, "UnbalancedBrackets", 0, 0),
    (b"{", 1024, "UnbalancedBrackets", 0, 0),
    (b"[[", 1024, "UnbalancedBrackets", 1, 1),
    (b"1]", 1024, "UnbalancedBrackets", 1, 1),
    (b"{}}", 1024, "UnbalancedBrackets", 2, 2),
    (b"[[]]]", 1024, "UnbalancedBrackets", 4, 4),
    (b"[1}", 1024, "UnbalancedBrackets", 2, 2),
    (b"{}},[1", 1024, "UnbalancedBrackets", 2, 2),
    (b'{"x", null}', 1024, "MissingColon", 4, 4),
    (b'{"a"', 1024, "MissingColon", 4, 4),
    (b'{"a":1,2}', 1024, "MissingColon", 6, 6),
    (b'["": 1]', 1024, "UnexpectedToken", 3, 3),
    (b'"a":1', 1024, "UnexpectedToken", 3, 3),
    (b'[1,"a":2]', 1024, "UnexpectedToken", 6, 6),
    (b"[True]", 1024, "UnexpectedToken", 1, 1),
    (b"\xef\xbb\xbf{}", 1024, "UnexpectedToken", 0, 0),
    (b'["x", truth]', 1024, "InvalidLiteral", 6, 6),
    (b"[01]", 1024, "InvalidNumber", 1, 1),
    (b'{"k":1e999}', 1024, "InvalidNumber", 5, 5),
    (b'["\\q"]', 1024, "InvalidStringEscape", 2, 2),
    (b'["a\x01"]', 1024, "ControlCharacterInString", 3, 3),
    (b'"abc', 1024, "UnterminatedString", 0, 4),
    (b'{"a', 1024, "UnterminatedString", 1, 3),
    (b'["a", "b', 1024, "UnterminatedString", 6, 8),
    (b"[[[[]]]]", 3, "DepthLimit", 3, 3),
    (b"[[[]]]", 3, "ok", -1, -1),
    (b"[" * 1025 + b"]" * 1025, 1024, "DepthLimit", 1024, 1024),
    (b"[" * 1024 + b"]" * 1024, 1024, "ok", -1, -1),
    (b'{"k":1,"k":2}', 1024, "ok", -1, -1),
    (b"[1,]", 1024, "UnexpectedToken", 3, 3),
    (b"[,1]", 1024, "UnexpectedToken", 1, 1),
    (b"{'a':1}", 1024, "UnexpectedToken", 1, 1),
    (b"[NaN]", 1024, "UnexpectedToken", 1, 1),
    (b"-0.0", 1024, "ok", -1, -1),
)
#: Fixed values: (number, kind, its 64 bits as a signed number).
NUMBERS = (
    ("0", "int64", 0),
    ("-0", "int64", 0),
    ("42", "int64", 42),
    ("9223372036854775807", "int64", 9223372036854775807),
    ("-9223372036854775808", "int64", -9223372036854775808),
    ("9223372036854775808", "uint64", -9223372036854775808),
    ("18446744073709551615", "uint64", -1),
    ("18446744073709551616", "double", 4895412794951729152),
    ("-9223372036854775809", "double", -4332462841530417152),
    ("-0.0", "double", -9223372036854775808),
    ("2.5", "double", 4612811918334230528),
    ("5e-324", "double", 1),
    ("1e-400", "double", 0),
    ("1e400", "bad", 0),
    ("01", "bad", 0),
    ("1.", "bad", 0),
    ("-", "bad", 0),
    ("+1", "bad", 0),
    ("1e", "bad", 0),
    (".5", "bad", 0),
    ("0x1", "bad", 0),
    (" 5", "bad", 0),
)
#: Fixed values: (string token, offset of its first error or -1, error).
STRINGS = (
    ('"plain"', -1, "ok"),
    ('"\\u0041\\n"', -1, "ok"),
    ('"\\ud83d\\ude00"', -1, "ok"),
    ('"\\ud83d"', 1, "InvalidStringEscape"),
    ('"\\ude00"', 1, "InvalidStringEscape"),
    ('"\\ud83d\\u0041"', 1, "InvalidStringEscape"),
    ('"é\\x"', 3, "InvalidStringEscape"),
    ('"ab\\u12"', 3, "InvalidStringEscape"),
    ('"a\tb"', 2, "ControlCharacterInString"),
)
#: Fixed values: (document, a, b, error) of a struct (a tinyint, b string) that arrays may stand for.
POSITIONS = (
    ('[1,"x"]', 1, "x", ""),
    ('{"b":"y","a":2}', 2, "y", ""),
    ('[1,"x",3]', None, None, "invalid length 3, expected fewer elements in array"),
    ("[1]", None, None, "invalid length 1, expected struct with 2 elements"),
    ('{"a":300,"b":"z"}', None, None, "invalid value: integer `300`, expected tinyint"),
    ('{"a":1,"a":2}', None, None, "duplicate field `a`"),
    ('{"a":"1"}', None, None, "invalid type: string, expected tinyint"),
    ("7", None, None, "invalid type: integer, expected struct"),
    ("null", None, None, ""),
    ("{}", None, None, ""),
)
#: Fixed values: (document, entries, failed) of a map from integers to strings.
MAPS = (
    ('{"1":"a","2":"b"}', "1=a,2=b", False),
    ('{"1":"a","1":"c"}', "1=c", False),
    ('{"x":"a"}', "null", True),
    ('{"1":2}', "null", True),
    ("{}", "", False),
)
#: Fixed values: (document, variant, has payload, failed).
ENUMS = (
    ('"Unit"', "Unit", False, False),
    ('{"Newtype":7}', "Newtype", True, False),
    ('{"Tuple":[1,"x"]}', "Tuple", True, False),
    ('{"Struct":{"ok":true}}', "Struct", True, False),
    ('"Other"', "", False, True),
    ('{"Newtype":1,"Tuple":2}', "", False, True),
    ("5", "", False, True),
)


def _word(tag: str, payload: int) -> int:
    w = ord(tag) << 56 | payload
    return w - (1 << 64) if w >> 63 else w


#: A document and its tape, by the layout's rules.
TAPE = (
    '{"a":[1,2.5],"b":"x\\n"}',
    (_word("r", 12), _word("{", 2 << 32 | 12), _word('"', 0), _word("[", 2 << 32 | 9), _word("l", 0), 1, _word("d", 0), 4612811918334230528, _word("]", 3), _word('"', 6), _word('"', 12), _word("}", 1), _word("r", 0)),
)
#: Samples whose contenders cross between 2,000 and 4,000 bytes.
CROSSOVER = tuple((f"d{b}", c, b, s + e) for b, a, o in ((1000, 3.0, 1.0), (2000, 3.0, 2.0), (4000, 4.0, 5.0), (8000, 5.0, 9.0)) for c, s in (("a", a), ("b", o)) for e in (0.0, -0.1, 0.1))
#: Fixed values: (document, as unsigned, as boolean, null, empty, raw count or -1).
ACCESS = (
    ("18446744073709551615", "18446744073709551615", None, False, None, -1),
    ("true", None, True, False, None, -1),
    ("null", None, None, True, None, -1),
    ("[]", None, None, False, True, 0),
    ('{"a":1,"b":[2]}', None, None, False, False, 2),
    ('"x"', None, None, False, None, -1),
)
#: Fixed values: (document, as double, as a 128-bit integer, both null where they fail, whether it is a unit).
WIDE = (
    ("7", 7.0, "7", False),
    ("18446744073709551615", 18446744073709551615.0, "18446744073709551615", False),
    ("-9223372036854775808", -9223372036854775808.0, "-9223372036854775808", False),
    ("1.5", 1.5, None, False),
    ("18446744073709551616", 18446744073709551616.0, None, False),
    ("null", None, None, True),
    ('"7"', None, None, False),
)
#: Fixed values: (document, first or -1, second, error) of tuples of an integer and a string.
TUPLES = (
    ('[1,"x"]', 1, "x", ""),
    ('[1,"x",2]', -1, None, "invalid length 3, expected fewer elements in array"),
    ('{"_1":1}', -1, None, "invalid type: map, expected tuple"),
)
#: A document, and where its structural tokens stand in a stable sort by depth.
SORTED = ('{"a":[{}]}', (0, 1, 3, 5, 6, 4, 2))
