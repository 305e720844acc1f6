"""The regular expressions of the compliance rules."""

SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"\(\d{3}\)\s?\d{3}-\d{4}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MRN = r"MRN\d{6,}"
CARD = r"\d{4}-?\d{4}-?\d{4}-?\d{4}"

# Further Safe Harbor identifiers (dates, web addresses, network addresses, zip codes).
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
URL = r"https?://[^\s\"'<>]+"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"

# For long texts: a match can only begin where a run of name characters begins or where the last
# match ended, so a run without "@" is read once and not once per character. Same matches as EMAIL.
EMAIL_IN_TEXT = r"(?:(?<![a-zA-Z0-9._%+-])|\G)" + EMAIL

TEXT_PATTERNS = {
    "ssn": SSN, "phone": PHONE, "email": EMAIL_IN_TEXT, "medical_record_number": MRN, "credit_card": CARD,
}
SAFE_HARBOR_PATTERNS = {"date": ISO_DATE, "url": URL, "ip_address": IPV4}
