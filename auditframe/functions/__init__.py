"""auditframe.functions"""
