"""Table writes: versioned keyed upserts, appends, snapshots and CSV exports."""
