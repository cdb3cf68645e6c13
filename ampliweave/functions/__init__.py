"""Functions from columns to columns: sequences, distances, qualities, CIGARs, tags, edit events. All are built-in Catalyst expressions."""
