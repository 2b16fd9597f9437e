"""auditframe.sources"""
