"""Building blocks shared by the reports."""
