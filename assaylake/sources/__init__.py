"""Reading tables, sheets, features and annotations; writing scores and reports."""
