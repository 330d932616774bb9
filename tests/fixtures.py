"""Input files of the end-to-end tests."""

CLEAN_CSV = (
    "txn_id,date,amount,currency,merchant,category\n"
    "K-701,2026-06-02,64.20,AED,Maple Grocers,grocery\n"
    "K-702,2026-06-05,47.25,AED,City Cabs,transport\n"
)
DRIFTED_CSV = (
    "transaction_id,transaction_date,amount_aed,merchant_name,category\n"
    'K-801,03/07/2026,"1,340.00",Pixel Barn,electronics\n'
    "K-802,05/07/2026,47.25,City Cabs,transport\n"
    "K-802,05/07/2026,47.25,City Cabs,transport\n"
)
MAILS = (
    "From: lena.v@heronpaper.example\nSubject: Open balance\nDate: 2026-07-10\n---\n"
    "Ring the desk at +971 50 664 2083 before paying HPW-31-01.\n"
    "=====\n"
    "From: tomas@juniper.example\nSubject: New courier at the dock\nDate: 2026-07-12\n---\n"
    "Ask for the courier at 055-310-7729 whose card number is\n784-1987-5550123-4 at the gate.\n"
)
FULL_INVOICE = (
    "INVOICE\nInvoice Number: HPW-31-01\nVendor: Heron Paper Works\n"
    "Invoice Date: 2026-07-01\nDue Date: 2026-08-01\nItems: Ream boxes x 40\nTotal: AED 3,915.00"
)
PHONE_INVOICE = (
    "INVOICE\nInvoice Number: HPW-31-02\nVendor: Juniper Haulage\n"
    "Invoice Date: 2026-07-05\nDue Date: 2026-08-05\nContact: +971 50 664 2083\n"
    "Items: Pallet moves\nTotal: AED 8,64.20"
)
PARTIAL_INVOICE = (
    "INVOICE\nInvoice Number: HPW-31-03\nVendor: Lantern Studio\n"
    "Invoice Date: 2026-07-08\nNote: price follows once the scope is agreed."
)
INVOICE_TEXTS = [
    ("invoice_001.pdf", FULL_INVOICE),
    ("invoice_002.pdf", PHONE_INVOICE),
    ("invoice_003.pdf", PARTIAL_INVOICE),
]


def write_folder(folder):
    """A folder with every kind of file; returns the invoice texts."""
    (folder / "clean.csv").write_text(CLEAN_CSV)
    (folder / "drifted.csv").write_text(DRIFTED_CSV)
    (folder / "bad.csv").write_text("transaction_id,amount\nT-1,n/a\nT-2,\nT-3,5\n")
    (folder / "header_only.csv").write_text("txn_id,date,amount,currency,merchant,category\n")
    (folder / "zero.csv").write_bytes(b"")
    (folder / "latin.csv").write_bytes(b"txn_id,date\nT-1,caf\xe9\n")
    (folder / "_hidden.csv").write_text(CLEAN_CSV)
    (folder / "a b+c%.csv").write_text("﻿" + CLEAN_CSV.replace("T-", "B-"))
    (folder / "emails.txt").write_text(MAILS)
    (folder / "crlf.eml").write_bytes(MAILS.replace("\n", "\r\n").encode())
    (folder / "notes.txt").write_text("just notes, call 055-310-7729")
    (folder / "notes.docx").write_bytes(b"binary-ish content")
    (folder / ".skipped.csv").write_text(CLEAN_CSV)
    for name, _ in INVOICE_TEXTS:
        (folder / name).write_bytes(b"%PDF-1.4")
    (folder / "blank.pdf").write_bytes(b"%PDF-1.4")
