"""confluo.plans"""
