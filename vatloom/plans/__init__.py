"""vatloom.plans"""
