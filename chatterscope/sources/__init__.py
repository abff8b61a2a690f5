"""Reading landed records and stored tables; writing snapshots and reports."""
