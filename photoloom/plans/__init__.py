"""photoloom.plans"""
