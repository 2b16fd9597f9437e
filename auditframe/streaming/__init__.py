"""auditframe.streaming"""
