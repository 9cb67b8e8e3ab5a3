"""Account numbers with capitals and digits behind them."""

from murmur.llm import pii

from .test_operators import frame


def test_account_numbers_before_capitals_and_digits(spark):
    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    texts = [f"{gb} Please", f"é {de} BIC COBADEFF", f"{de} {gb} 7 X", f"{de}X", f"to {gb}", "AB12 " * 4000, f"{de[:-1]}1 BIC"]
    rows = pii.personal_data(frame(spark, texts)).collect()
    got = {x["doc_id"]: [texts[x["doc_id"]][s["start"]:s["end"]] for s in x["findings"] if s["kind"] == "iban"] for x in rows}
    assert [got[i] for i in range(len(texts))][:5] == [[gb], [de], [de, gb], [], [gb]] and got[6] == []
