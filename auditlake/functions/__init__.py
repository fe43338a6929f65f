"""Part of auditlake."""
