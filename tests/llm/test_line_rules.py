"""Lines that are the same but for case, white space or one edit."""

from __future__ import annotations

from lumenkg.llm import linededup


def removed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.n_removed for r in linededup.counted(df).collect()}


def test_case_and_white_space(spark):
    line = "one two three four five six seven eight nine ten"
    edited = line.replace("five", "x")
    texts = [line, line.title(), line.replace(" ", "\t"), edited + "\r", line.replace(" ", " ") + "　", "short line", "Short LINE\r", "　\t\r", line.replace("two", "y").replace("nine", "z")]
    assert removed(spark, texts) == {k: int(k in (1, 2, 3, 4, 6)) for k in range(len(texts))}
    assert [r.n_lines for r in linededup.counted(spark.createDataFrame([(0, "　\t\r\na")], "doc_id long, text string")).collect()] == [1]


def test_lines_of_few_words(spark):
    seven = "several words of which one is misspelt"
    han = "今天天气很好我们一起去公园散步然后回家吃饭"
    long = "".join(chr(0x4E00 + k * 7919 % 20000) for k in range(3000))
    texts = [seven, seven.replace("misspelt", "mispelt"), han, han.replace("公园", "公圆"), han.replace("我们", "") + "了", long, long[:1500] + "x" + long[1500:], "https://host.example/a/long/path?key=1", "https://host.example/a/long/path?key=2", "Chapter 1", "Chapter 2"]
    texts += ["𝒜" * 3 + "bcdefghijklmn", "𝒜" * 4 + "bcdefghijklmn", "a b c d e f g h i j k l m", "abcdefghijklm", "eight words with a blank put in some where", "eight words with a blank put in somewhere"]
    texts += ["seven words and no blank put somewhere", "seven words and no blank put some where", "a word is replaced in seven words", "a word is missing in seven words"]
    assert removed(spark, texts) == {k: int(k in (1, 3, 6, 8, 12, 18)) for k in range(len(texts))}
