"""Account numbers end where their country says, whatever follows them."""

from lintfleet.llm import pii

DE, GB, NO = "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "NO9386011117947"


def test_account_numbers_before_capitals_and_digits(docs_of):
    rows = [(1, f"IBAN {DE} Please pay"), (2, f"IBAN {DE} BIC COBADEFFXXX"), (3, "IBAN DE89 3704 0044 0532 0130 00 2024 EUR"),
            (4, f"{GB} {NO} NOW"), (5, f"IBAN {DE}1 or {DE[:-1]}"), (6, "IBAN LU28 DE89 3704 0044 0532 0130 00."),
            (7, "IBAN DE89370400440532013001 Please"), (8, "AB12 " * 5000)]
    out = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in pii.find_personal_data(docs_of(rows)).collect()}
    assert out[1] == out[2] == [(5, 27)] and out[3] == [(5, 32)] and out[6] == [(10, 37)]
    assert out[4] == [(0, len(GB)), (len(GB) + 1, len(GB) + 1 + len(NO))]
    assert out[5] == out[7] == out[8] == []
    masked = {r.doc_id: r.text for r in pii.masked(docs_of(rows)).collect()}
    assert masked[1] == "IBAN [iban] Please pay" and masked[3] == "IBAN [iban] 2024 EUR"
