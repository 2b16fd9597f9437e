"""auditframe.plans"""
