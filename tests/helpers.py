"""What test modules share besides fixtures."""

import datetime as dt

SF = "/root/testdata/sf0.001"


def day(text):
    return dt.date.fromisoformat(text) if text else None


SPANS = {"Q1": ("01-01", "03-31"), "H1": ("01-01", "06-30"), "9M": ("01-01", "09-30"), "FY": ("01-01", "12-31"), "Q2": ("04-01", "06-30"), "Q3": ("07-01", "09-30"), "Q4": ("10-01", "12-31")}
